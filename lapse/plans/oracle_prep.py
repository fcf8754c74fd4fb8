"""Oracle SQL for lapse.plans.q_prep (generated per column from the same column lists)."""

from lapse.operators.features import FEATURE_COLUMNS
from lapse.operators.pipeline import CATEGORICAL_COLS, MEDIAN_COLS, OUTPUT_COLS, SCALE_COLS, SENTINEL_COLS
from lapse.params import TEST_PARAMS as P
from lapse.plans.oracle_base import R, with_base

DERIVED = ("registration_tenure_days", "avg_song_completion", "total_secs_log", "log1p_fwd_rev",
           "avg_num_unq_songs", "recent_engagement_ratio", "secs_trend_recent_vs_prior",
           "numunq_trend_recent_vs_prior")
# Fixed values, stated here on their own: what is profiled.
NUMERIC = ("is_churn", "bd", "fwd_rev", "num_transactions", "avg_payment_plan_days", "avg_actual_amount_paid", "is_auto_renew_rate",
           "is_cancel_rate", "avg_discount_rate", "num_distinct_payment_methods", "most_recent_payment_plan_days",
           "most_recent_actual_amount_paid", "most_recent_is_auto_renew", "most_recent_is_cancel", "days_since_last_login",
           "days_since_last_cancel", "daily_active_days", "recent_daily_active_days", "total_secs_sum", "sum25", "sum50", "sum75",
           "sum985", "sum100", "sum_unq", "recent_secs", "prior_secs", "recent_numunq", "prior_numunq", *DERIVED)
SPIKE_COLS = ("city", "gender", "registered_via", "payment_method_id")
F0 = repr(P.split_fracs[0])
F1 = repr(P.split_fracs[0] + P.split_fracs[1])
Q = '"column"'


def _h(key, salt=""):
    return f"('0x' || substr(md5('{salt}{P.seed}:' || CAST({key} AS VARCHAR)), 1, 8))::UBIGINT"


_mt = ("mt AS (SELECT * REPLACE (coalesce(gender, 'unknown') AS gender), "
       "CASE WHEN bd BETWEEN 1 AND 100 THEN bd END AS bd_clean FROM derived)")
_sp = (f"sp AS (SELECT *, CASE WHEN pos <= floor(ns * CAST('{F0}' AS DOUBLE)) THEN 'train' "
       f"WHEN pos <= floor(ns * CAST('{F1}' AS DOUBLE)) THEN 'val' ELSE 'test' END AS split "
       f"FROM (SELECT *, row_number() OVER (PARTITION BY is_churn ORDER BY md5('{P.seed}:' || CAST(msno AS VARCHAR)), msno) AS pos, "
       f"count(*) OVER (PARTITION BY is_churn) AS ns FROM mt))")
_fit = ("fit AS (SELECT " + ", ".join([f"median({c}) AS m_{c}" for c in MEDIAN_COLS]
                                      + [f"max({c}) + 30 AS s_{c}" for c in SENTINEL_COLS])
        + " FROM sp WHERE split = 'train')")
_imp_cols = ([f"coalesce(CAST(sp.{c} AS DOUBLE), fit.m_{c}) AS {c}" for c in MEDIAN_COLS]
             + [f"coalesce(CAST(sp.{c} AS DOUBLE), CAST(fit.s_{c} AS DOUBLE)) AS {c}" for c in SENTINEL_COLS])
_imp = ("imp AS (SELECT sp.* REPLACE (" + ", ".join(_imp_cols) + "), "
        "sp.num_transactions / (greatest(coalesce(CAST(sp.registration_tenure_days AS DOUBLE), "
        "fit.m_registration_tenure_days), 0.0) + 1.0) AS txn_frequency FROM sp, fit)")
_enc = ", ".join(
    f"enc_{c} AS (SELECT {c} AS v, row_number() OVER (ORDER BY {c}) - 1 AS idx "
    f"FROM (SELECT DISTINCT {c} FROM imp WHERE split = 'train' AND {c} IS NOT NULL))"
    for c in CATEGORICAL_COLS)
_sc = ("sc AS (SELECT " + ", ".join(f"avg(CAST({c} AS DOUBLE)) AS mu_{c}, stddev_pop(CAST({c} AS DOUBLE)) AS sd_{c}"
                                    for c in SCALE_COLS) + " FROM imp WHERE split = 'train')")
_ds_cols = (["imp.*"]
            + [f"CAST(coalesce(enc_{c}.idx, (SELECT count(*) FROM enc_{c})) AS BIGINT) AS {c}_enc"
               for c in CATEGORICAL_COLS]
            + [f"(CAST(imp.{c} AS DOUBLE) - sc.mu_{c}) / CASE WHEN sc.sd_{c} = 0 THEN 1.0 ELSE sc.sd_{c} END "
               f"AS {c}_scaled" for c in SCALE_COLS])
_ds = ("ds AS (SELECT " + ", ".join(_ds_cols) + " FROM imp CROSS JOIN sc "
       + " ".join(f"LEFT JOIN enc_{c} ON imp.{c} = enc_{c}.v" for c in CATEGORICAL_COLS) + ")")
_PIPE = f"WITH {_mt}, {_sp}, {_fit}, {_imp}, {_enc}, {_sc}, {_ds}"


def _union(cols, tmpl):
    return " UNION ALL ".join(tmpl.format(c=c) for c in cols)


ORACLE = {
    "feature_describe": with_base(_union(NUMERIC, (
        "SELECT '{c}' AS \"column\", count(x) AS \"count\", round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, "
        "round(min(x), 6) AS \"min\", round(max(x), 6) AS \"max\", round(quantile_cont(x, 0.25), 6) AS p25, "
        "round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.75), 6) AS p75 "
        "FROM (SELECT CAST({c} AS DOUBLE) AS x FROM derived)"))),
    "null_profile": with_base(_union(list(FEATURE_COLUMNS) + list(DERIVED), (
        "SELECT '{c}' AS \"column\", CAST(count_if({c} IS NULL) AS BIGINT) AS n_null FROM derived"))),
    "value_counts": with_base(f"""
SELECT coalesce(gender, 'missing') AS value, count(*) AS n,
       {R('count(*) * 100.0 / (SELECT count(*) FROM members)', 6, 'pct')} FROM members GROUP BY 1"""),
    "histograms": with_base(f"""
WITH v AS ({_union(NUMERIC, "SELECT '{c}' AS " + Q + ", CAST({c} AS DOUBLE) AS value FROM derived WHERE {c} IS NOT NULL")}),
r AS (SELECT {Q}, min(value) AS lo, max(value) AS hi FROM v GROUP BY 1),
b AS (SELECT v.{Q}, CAST(CASE WHEN r.hi = r.lo THEN 0
                     ELSE least(floor((v.value - r.lo) / ((r.hi - r.lo) / 50)), 49) END AS BIGINT) AS bin, r.lo, r.hi
      FROM v JOIN r USING ({Q}))
SELECT {Q}, bin, round(lo + bin * (hi - lo) / 50, 6) AS bin_lo, round(lo + (bin + 1) * (hi - lo) / 50, 6) AS bin_hi,
       count(*) AS n FROM b GROUP BY {Q}, bin, lo, hi"""),
    "kde_grid": with_base("""
WITH v AS (SELECT total_secs_log AS x FROM derived WHERE total_secs_log IS NOT NULL),
st AS (SELECT min(x) AS lo, max(x) AS hi, n, sd * pow(CAST(n AS DOUBLE), -0.2) AS bw
       FROM (SELECT min(x) AS lo0, max(x) AS hi0, stddev_samp(x) AS sd, count(x) AS n FROM v) s, v GROUP BY n, sd),
vt AS (SELECT x, count(*) AS c FROM v GROUP BY x),
g AS (SELECT range AS i FROM range(64)),
gx AS (SELECT g.i, st.lo + g.i * (st.hi - st.lo) / 63 AS x, st.n, st.bw FROM g, st)
SELECT gx.i, round(gx.x, 6) AS x,
       round(sum(vt.c * exp(-0.5 * ((gx.x - vt.x) / gx.bw) * ((gx.x - vt.x) / gx.bw)))
             / (gx.n * gx.bw * sqrt(2 * pi())), 6) AS density
FROM gx, vt GROUP BY gx.i, gx.x, gx.n, gx.bw"""),
    "dominant_bins": with_base(f"""
WITH v AS ({_union(NUMERIC, "SELECT '{c}' AS " + Q + ", round(CAST({c} AS DOUBLE), 9) AS value FROM derived WHERE {c} IS NOT NULL")}),
r AS (SELECT {Q}, min(value) AS lo, max(value) AS hi, count(*) AS n FROM v GROUP BY 1),
f AS (SELECT {Q}, value, count(*) AS c, row_number() OVER (PARTITION BY {Q} ORDER BY count(*) DESC, value DESC) AS nth FROM v GROUP BY 1, 2),
b AS (SELECT {Q}, bin, count(*) AS c, row_number() OVER (PARTITION BY {Q} ORDER BY count(*) DESC, bin) AS nth
      FROM (SELECT v.{Q}, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((value - lo) / ((hi - lo) / 50)), 49) END AS BIGINT) AS bin
            FROM v JOIN r USING ({Q})) GROUP BY 1, 2)
SELECT {Q}, r.n, round(f.value, 6) AS top_value, round(f.c / r.n, 6) AS value_share, b.bin AS top_bin,
       round(lo + b.bin * (hi - lo) / 50, 6) AS bin_lo, round(lo + (b.bin + 1) * (hi - lo) / 50, 6) AS bin_hi, round(b.c / r.n, 6) AS bin_share
FROM r JOIN f USING ({Q}) JOIN b USING ({Q}) WHERE f.nth = 1 AND b.nth = 1"""),
    "correlation_matrix": with_base(" UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS corr "
        f"FROM derived" for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1:])),
    "spike_share": with_base(f"""
WITH m2 AS (SELECT * REPLACE (coalesce(gender, 'unknown') AS gender) FROM derived),
v AS ({_union(SPIKE_COLS, "SELECT '{c}' AS " + Q + ", CAST({c} AS VARCHAR) AS value FROM m2")}),
g AS (SELECT {Q}, value, count(*) AS n FROM v GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY {Q} ORDER BY n DESC, value DESC NULLS LAST) AS rn,
             sum(n) OVER (PARTITION BY {Q}) AS tot FROM g)
SELECT {Q}, value AS top_value, n AS top_n, CAST(tot AS BIGINT) AS n, round(n / tot, 6) AS top_share
FROM r WHERE rn = 1"""),
    "stratified_split": with_base(f"{_PIPE} SELECT msno, is_churn, split FROM sp"),
    "stratified_sample": with_base(f"""
SELECT msno, is_churn FROM lab
WHERE CAST({_h('msno', 'sample:')} AS DOUBLE) / 4294967296.0
      < CASE is_churn WHEN 1 THEN CAST('0.2' AS DOUBLE) WHEN 0 THEN CAST('0.5' AS DOUBLE) END"""),
    "kfold_assignment": with_base(f"SELECT msno, CAST({_h('msno')} % 2 AS BIGINT) AS fold FROM lab"),
    "median_impute": with_base(
        f"{_PIPE} SELECT msno, split, " + ", ".join(R(c) for c in MEDIAN_COLS + SENTINEL_COLS + ("txn_frequency",))
        + " FROM imp"),
    "label_encode": with_base(
        f"{_PIPE} SELECT msno, split, " + ", ".join(f"{c}_enc" for c in CATEGORICAL_COLS) + " FROM ds"),
    "standard_scale": with_base(
        f"{_PIPE} SELECT msno, split, " + ", ".join(R(f"{c}_scaled") for c in SCALE_COLS) + " FROM ds"),
    "split_verification": with_base(
        f"{_PIPE}, nn AS (SELECT split, is_churn, fwd_rev, "
        + " + ".join(f"CAST({c} IS NULL AS BIGINT)" for c in OUTPUT_COLS if c != "msno")
        + " AS nulls FROM ds) SELECT split, count(*) AS n, round(avg(is_churn), 6) AS churn_rate, "
          "CAST(sum(nulls) AS BIGINT) AS total_nulls, round(quantile_cont(fwd_rev, 0.5), 6) AS fwd_rev_median "
          "FROM nn GROUP BY split"),
}
