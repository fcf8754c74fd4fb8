"""DuckDB oracle: the adapters and the rules of SURVEY section 2, written as SQL of its own.

Shapes differ from the Spark plans on purpose: reference dates come from a window over
a user's paid rows, labels from the distance in days to the next transaction, and
every feature from one union of a user's dated facts, labelled by source and
counted in days before the reference date.  Parameters come from ``TEST_PARAMS``.
"""

from __future__ import annotations

from lapse.params import TEST_PARAMS as P

CUTOFF = f"DATE '{P.cutoff.isoformat()}'"
LAST = f"DATE '{P.last_date.isoformat()}'"
GRACE = P.grace_days
FWD = P.fwd_window_days
WIN = P.engagement_days
REC = P.recent_days
PRIOR = P.prior_days

_D = "CAST(substr(o_orderpriority, 1, 1) AS BIGINT)"


def user_chain(s: str, txn: str, refs: str) -> dict[str, str]:
    """Labels and features of the users of table ``refs`` from the transactions in ``txn``; names end in ``s``."""
    secs = "greatest(0.0, least(86400.0, total_secs))"
    log = f"src = 'log' AND ago < {WIN}"
    new, old = f"src = 'log' AND ago < {REC}", f"src = 'log' AND ago >= {REC} AND ago < {WIN}"

    def over(f: str, cond: str) -> str:
        return f"{f} FILTER (WHERE {cond})"

    return {
        f"moves{s}": f"""moves{s} AS (
  SELECT r.msno, r.ref_date,
         min(t.txn_dt - r.ref_date) FILTER (WHERE t.txn_dt > r.ref_date) AS gap_any,
         min(t.txn_dt - r.ref_date) FILTER (WHERE t.txn_dt > r.ref_date AND t.actual_amount_paid > 0) AS gap_paid,
         sum(t.actual_amount_paid) FILTER (WHERE t.txn_dt - r.ref_date BETWEEN 1 AND {FWD}) AS fwd_rev
  FROM {refs} r LEFT JOIN {txn} t ON t.msno = r.msno GROUP BY r.msno, r.ref_date)""",
        f"lab{s}": f"""lab{s} AS (
  SELECT msno, ref_date, CAST(coalesce(gap_any, {GRACE} + 1) > {GRACE} AS BIGINT) AS is_churn, fwd_rev FROM moves{s})""",
        f"past{s}": f"""past{s} AS (
  SELECT t.*, 'txn' AS src, r.ref_date - t.txn_dt AS ago FROM {refs} r, {txn} t WHERE t.msno = r.msno AND t.txn_dt <= r.ref_date
  UNION ALL BY NAME
  SELECT l.*, 'log' AS src, r.ref_date - l.log_dt AS ago FROM {refs} r, user_logs l WHERE l.msno = r.msno AND l.log_dt <= r.ref_date)""",
        f"profile{s}": f"""profile{s} AS (
  SELECT msno, {over('count(*)', "src = 'txn'")} AS num_transactions,
         avg(payment_plan_days) AS avg_payment_plan_days, avg(actual_amount_paid) AS avg_actual_amount_paid,
         avg(is_auto_renew) AS is_auto_renew_rate, avg(is_cancel) AS is_cancel_rate,
         {over('avg((plan_list_price - actual_amount_paid) / plan_list_price)', 'plan_list_price > 0')} AS avg_discount_rate,
         count(DISTINCT payment_method_id) AS num_distinct_payment_methods,
         (list({{'m': payment_method_id, 'd': payment_plan_days, 'a': actual_amount_paid, 'r': is_auto_renew, 'c': is_cancel}}
               ORDER BY ago, txn_id DESC) FILTER (WHERE src = 'txn'))[1] AS newest,
         {over('min(ago)', "src = 'log'")} AS days_since_last_login, {over('min(ago)', 'is_cancel = 1')} AS days_since_last_cancel,
         {over('count(DISTINCT ago)', log)} AS daily_active_days, {over('count(DISTINCT ago)', new)} AS recent_daily_active_days,
         {over(f'sum({secs})', log)} AS total_secs_sum, {over(f'sum({secs})', new)} AS recent_secs,
         {over(f'sum({secs})', old)} AS prior_secs, {over(f'stddev_samp({secs})', log)} AS std_dev_daily_secs,
         {over('sum(num_unq)', log)} AS sum_unq, {over('sum(num_unq)', new)} AS recent_numunq, {over('sum(num_unq)', old)} AS prior_numunq,
         {', '.join(f"{over(f'sum(num_{k})', log)} AS sum{k}" for k in (25, 50, 75, 985, 100))}
  FROM past{s} GROUP BY msno)""",
        f"features{s}": f"""features{s} AS (
  SELECT lab{s}.* REPLACE (coalesce(fwd_rev, 0) AS fwd_rev), city, bd, gender, registered_via, registration_init_time,
         avg_payment_plan_days, avg_actual_amount_paid, newest.m AS payment_method_id,
         newest.d AS most_recent_payment_plan_days, newest.a AS most_recent_actual_amount_paid,
         days_since_last_login, days_since_last_cancel, std_dev_daily_secs,
         {', '.join(f"coalesce({c}, 0) AS {c}" for c in ("is_auto_renew_rate", "is_cancel_rate", "avg_discount_rate",
                                                         "total_secs_sum", "recent_secs", "prior_secs"))},
         {', '.join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c.split('.')[-1] if '.' not in c else n}" for c, n in (
             ("num_transactions", ""), ("num_distinct_payment_methods", ""), ("newest.r", "most_recent_is_auto_renew"),
             ("newest.c", "most_recent_is_cancel"), ("daily_active_days", ""), ("recent_daily_active_days", ""), ("sum25", ""),
             ("sum50", ""), ("sum75", ""), ("sum985", ""), ("sum100", ""), ("sum_unq", ""), ("recent_numunq", ""),
             ("prior_numunq", "")))}
  FROM lab{s} LEFT JOIN profile{s} USING (msno) LEFT JOIN members USING (msno))""",
        f"derived{s}": f"""derived{s} AS (
  SELECT *,
         ref_date - CAST(try_strptime(CAST(registration_init_time AS VARCHAR), '%Y%m%d') AS DATE) AS registration_tenure_days,
         (0.25 * sum25 + 0.50 * sum50 + 0.75 * sum75 + 0.985 * sum985 + 1.0 * sum100)
           / (CAST(sum25 + sum50 + sum75 + sum985 + sum100 AS DOUBLE) + 1) AS avg_song_completion,
         ln(1 + total_secs_sum) AS total_secs_log, ln(1 + fwd_rev) AS log1p_fwd_rev,
         sum_unq / (daily_active_days + 1.0) AS avg_num_unq_songs,
         recent_daily_active_days / (daily_active_days + 1.0) AS recent_engagement_ratio,
         (recent_secs / {REC}.0) / ((prior_secs / {PRIOR}.0) + 1) AS secs_trend_recent_vs_prior,
         (recent_numunq / {REC}.0) / ((prior_numunq / {PRIOR}.0) + 1) AS numunq_trend_recent_vs_prior
  FROM features{s})""",
    }


BASE = {
    "txn": f"""txn AS (
  SELECT o_custkey AS msno, o_orderkey AS txn_id,
         {_D} AS payment_method_id,
         30 * {_D} AS payment_plan_days,
         CASE WHEN o_orderkey % 13 = 0 THEN 0.0
              ELSE o_totalprice * (1.0 + CAST(o_orderkey % 4 AS DOUBLE) * 0.05) END AS plan_list_price,
         CASE WHEN o_orderkey % 17 = 0 THEN 0.0 ELSE o_totalprice END AS actual_amount_paid,
         CAST(CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END AS BIGINT) AS is_auto_renew,
         CAST(CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS is_cancel,
         CAST(o_orderdate AS DATE) AS txn_dt,
         CASE WHEN o_orderkey % 97 = 0 THEN CAST(o_orderdate AS DATE) - 5
              ELSE CAST(o_orderdate AS DATE) + 30 * CAST(substr(o_orderpriority, 1, 1) AS INTEGER) END AS expire_dt
  FROM orders)""",
    "paid": "paid AS (SELECT * FROM txn WHERE actual_amount_paid > 0)",
    "members": """members AS (
  SELECT c_custkey AS msno, CAST(c_nationkey AS BIGINT) AS city,
         CAST(floor(c_acctbal / 50) AS BIGINT) AS bd,
         CASE c_mktsegment WHEN 'BUILDING' THEN 'male' WHEN 'AUTOMOBILE' THEN 'female' END AS gender,
         CAST(c_custkey % 6 + 3 AS BIGINT) AS registered_via,
         CAST(strftime(DATE '1994-01-01' + CAST(c_custkey % 900 AS INTEGER), '%Y%m%d') AS BIGINT)
           AS registration_init_time
  FROM customer)""",
    "user_logs": """user_logs AS (
  SELECT o.o_custkey AS msno, CAST(l.l_shipdate AS DATE) AS log_dt,
         CAST(sum(CASE WHEN l.l_linenumber = 1 THEN l.l_quantity ELSE 0.0 END) AS BIGINT) AS num_25,
         CAST(sum(CASE WHEN l.l_linenumber = 2 THEN l.l_quantity ELSE 0.0 END) AS BIGINT) AS num_50,
         CAST(sum(CASE WHEN l.l_linenumber = 3 THEN l.l_quantity ELSE 0.0 END) AS BIGINT) AS num_75,
         CAST(sum(CASE WHEN l.l_linenumber = 4 THEN l.l_quantity ELSE 0.0 END) AS BIGINT) AS num_985,
         CAST(sum(CASE WHEN l.l_linenumber BETWEEN 5 AND 7 THEN l.l_quantity ELSE 0.0 END) AS BIGINT) AS num_100,
         CAST(count(DISTINCT l.l_partkey) AS BIGINT) AS num_unq,
         sum(l.l_extendedprice) AS total_secs
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  GROUP BY 1, 2)""",
    "cycles": """cycles AS (
  SELECT msno, expire_dt, expire_dt >= txn_dt AS sound, min(txn_dt) OVER (PARTITION BY msno) AS first_paid FROM paid)""",
    "refs": f"""refs AS (
  SELECT msno, any_value(first_paid) AS start_dt, max(expire_dt) AS ref_date FROM cycles
  WHERE sound AND expire_dt <= {CUTOFF} GROUP BY msno)""",
    "refs_open": """refs_open AS (
  SELECT msno, any_value(first_paid) AS start_dt, max(expire_dt) AS ref_date FROM cycles WHERE sound GROUP BY msno)""",
    "survival": f"""survival AS (
  SELECT msno, start_dt, ref_date AS last_expire_dt, ref_date - start_dt AS duration_days,
         CAST({LAST} - ref_date >= {GRACE} AS BIGINT) AS event_churned FROM refs_open)""",
    **user_chain("", "txn", "refs"),
    "churn_corrected": f"""churn_corrected AS (
  SELECT msno, ref_date, CAST(coalesce(gap_paid, {GRACE} + 1) > {GRACE} AS BIGINT) AS is_churn FROM moves)""",
}

ORDER = list(BASE)


def with_base(body: str) -> str:
    """Prefix ``body`` with every base CTE it (transitively) references."""
    import re
    needed: set[str] = set()

    def visit(text):
        for name in ORDER:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(BASE[name].split(" AS (", 1)[1])

    visit(body)
    ctes = [BASE[n] for n in ORDER if n in needed]
    if not ctes:
        return body
    head = "WITH " + ",\n".join(ctes)
    stripped = body.lstrip()
    if stripped[:5].upper() == "WITH ":
        return head + ",\n" + stripped[5:]
    return head + "\n" + body


def R(col: str, digits: int = 6, alias: str | None = None) -> str:
    """round(col, digits) AS alias — the oracle side of ``rnd``."""
    a = alias or col.split(".")[-1]
    return f"round({col}, {digits}) AS {a}"


def _split_args(inner: str):
    depth, quote = 0, False
    for i in range(len(inner) - 1, -1, -1):
        ch = inner[i]
        if ch == "'":
            quote = not quote
        elif quote:
            continue
        elif ch == ")":
            depth += 1
        elif ch == "(":
            depth -= 1
        elif ch == "," and depth == 0:
            return inner[:i], inner[i + 1:].strip()
    return inner, None


def fix_rounding(sql: str) -> str:
    """Rewrite every round(x, d) into round(x * 10^d) / 10^d + 0.0 on DOUBLE,
    the formula the Spark side uses (see plans.context.round_half_away)."""
    out, i = [], 0
    low = sql.lower()
    while True:
        j = low.find("round(", i)
        if j < 0 or (j > 0 and (low[j - 1].isalnum() or low[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        k, depth = j + 6, 1
        while depth:
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
            k += 1
        inner = fix_rounding(sql[j + 6:k - 1])
        expr, d = _split_args(inner)
        if d is None or not d.isdigit():
            out.append(sql[i:j] + "round(" + inner + ")")
        else:
            sc = f"CAST({10 ** int(d)} AS DOUBLE)"
            out.append(sql[i:j] + f"(round(CAST({expr} AS DOUBLE) * {sc}) / {sc} + 0.0)")
        i = k


AGE_CASE = """CASE WHEN {c} BETWEEN 1 AND 17 THEN '1-17'
            WHEN {c} BETWEEN 18 AND 24 THEN '18-24'
            WHEN {c} BETWEEN 25 AND 34 THEN '25-34'
            WHEN {c} BETWEEN 35 AND 44 THEN '35-44'
            WHEN {c} BETWEEN 45 AND 100 THEN '45-100'
            ELSE 'unknown/invalid' END"""

BASE.update({
    "cust_score": """cust_score AS (
  SELECT c_custkey AS msno,
         CAST(floor((c_acctbal - (SELECT min(c_acctbal) FROM customer))
              / ((SELECT max(c_acctbal) FROM customer) - (SELECT min(c_acctbal) FROM customer)) * 1024) / 1024
              AS DOUBLE) AS p_churn_raw
  FROM customer)""",
    "last_paid": """last_paid AS (
  SELECT p.msno, (list(p.actual_amount_paid ORDER BY p.txn_dt DESC, p.txn_id DESC))[1] AS last_paid
  FROM paid p SEMI JOIN refs r ON p.msno = r.msno AND p.txn_dt <= r.ref_date GROUP BY p.msno)""",
    "scored": """scored AS (
  SELECT l.msno, l.is_churn, coalesce(l.fwd_rev, 0.0) AS fwd_rev,
         coalesce(cs.p_churn_raw, 0.0) AS p_churn_raw,
         coalesce(lp.last_paid, 0.0) AS e_amount,
         coalesce(lp.last_paid, 0.0) * (1.0 - coalesce(cs.p_churn_raw, 0.0)) AS e_fwd_rev
  FROM lab l LEFT JOIN cust_score cs USING (msno) LEFT JOIN last_paid lp USING (msno))""",
    "results": """results AS (
  SELECT *, row_number() OVER (ORDER BY priority_score DESC, msno) AS rank FROM (
    SELECT *, p_churn * e_fwd_rev AS priority_score FROM (
      SELECT *, (rank() OVER (ORDER BY p_churn_raw) + (count(*) OVER (PARTITION BY p_churn_raw) - 1) / 2.0)
                / (SELECT count(*) FROM scored) AS p_churn
      FROM scored)))""",
    "latest_renew": """latest_renew AS (
  SELECT msno, (list(is_auto_renew ORDER BY txn_dt DESC, txn_id DESC))[1] AS is_auto_renew FROM paid GROUP BY msno)""",
})
ORDER[:] = list(BASE)
