"""Oracle SQL for the SQL-expressible model keys (given scores) and the survival
feature table."""

from lapse.params import TEST_PARAMS as P
from lapse.plans.oracle_base import R, user_chain, with_base

_SPLIT = f"""sp AS (SELECT *, CASE WHEN pos <= floor(ns * CAST('{P.split_fracs[0]!r}' AS DOUBLE)) THEN 'train'
                           WHEN pos <= floor(ns * CAST('{(P.split_fracs[0] + P.split_fracs[1])!r}' AS DOUBLE))
                           THEN 'val' ELSE 'test' END AS split
            FROM (SELECT *, row_number() OVER (PARTITION BY is_churn ORDER BY md5('{P.seed}:' || CAST(msno AS VARCHAR)), msno) AS pos,
                         count(*) OVER (PARTITION BY is_churn) AS ns FROM scored))"""

# Gate thresholds and the compared columns of the survival features.
GATE_THRESHOLDS = (0.0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6)
SURVIVAL_COLS = ("msno", "duration_days", "event_churned", "num_transactions", "avg_actual_amount_paid",
                 "payment_method_id", "most_recent_is_auto_renew", "days_since_last_login",
                 "daily_active_days", "total_secs_sum", "registration_tenure_days", "avg_song_completion",
                 "city", "gender", "registered_via")

_gate_vals = ", ".join(f"(CAST('{t!r}' AS DOUBLE))" for t in GATE_THRESHOLDS)
_logit = "ln(pp / (1.0 - pp))"
_mu = "ln(1 + e_amount) - 1.0"
_ls = "p_churn_raw - 0.5"
_mu_c = f"least(greatest({_mu}, -1.0), 9.0)"
_ls_c = f"least(greatest({_ls}, -3.0), 0.7)"

ORACLE = {
    "gate_sweep": with_base(f"""
WITH th AS (SELECT * FROM (VALUES {_gate_vals}) t(threshold)),
x AS (SELECT th.threshold, 1.0 - s.p_churn_raw AS p, s.e_amount AS a, s.fwd_rev AS y FROM scored s, th),
e AS (SELECT threshold, p, y, CASE WHEN p >= threshold THEN a ELSE 0.0 END - y AS err FROM x)
SELECT {R('threshold')}, {R('sqrt(avg(err * err))', 6, 'rmse')}, {R('1.0 - avg(err * err) / var_pop(y)', 6, 'r2')},
       CAST(count_if(p >= threshold) AS BIGINT) AS n_gated FROM e GROUP BY threshold"""),
    "ziln_point_estimate": with_base(f"""
WITH h AS (SELECT msno, fwd_rev, e_amount, p_churn_raw,
                  least(greatest(1.0 - p_churn_raw, 0.001), 0.999) AS pp FROM scored),
k AS (SELECT msno, fwd_rev, {_logit} AS lg, {_mu_c} AS mu, {_ls_c} AS ls FROM h)
SELECT msno,
       {R('least(1.0 / (1.0 + exp(-lg)) * exp(mu + exp(ls) * exp(ls) / 2), 1000000.0)', 6, 'e_ziln')},
       {R('greatest(lg, 0.0) - lg * CAST(fwd_rev > 0 AS DOUBLE) + ln(1 + exp(-abs(lg))) + '
          'coalesce(CAST(fwd_rev > 0 AS DOUBLE) * (ln(CASE WHEN fwd_rev > 0 THEN fwd_rev END) + ls + '
          '0.5 * ln(2 * pi()) + (ln(CASE WHEN fwd_rev > 0 THEN fwd_rev END) - mu) '
          '* (ln(CASE WHEN fwd_rev > 0 THEN fwd_rev END) - mu) / (2 * exp(2 * ls))), 0.0)', 6, 'loss')}
FROM k"""),
    "model_choice": with_base(f"""
WITH {_SPLIT},
m AS (SELECT 'hurdle' AS model, 0 AS priority, sqrt(avg((e_fwd_rev - fwd_rev) * (e_fwd_rev - fwd_rev))) AS rmse
      FROM sp WHERE split = 'val'
      UNION ALL
      SELECT 'last_amount', 1, sqrt(avg((e_amount - fwd_rev) * (e_amount - fwd_rev))) FROM sp WHERE split = 'val')
SELECT arg_min(model, (rmse, priority)) AS chosen,
       {R("max(rmse) FILTER (WHERE model = 'hurdle')", 6, 'rmse_incumbent')},
       {R("max(rmse) FILTER (WHERE model = 'last_amount')", 6, 'rmse_challenger')} FROM m"""),
    # least mean of a run that starts at a and ends at or after i, largest over a <= i; linear between blocks
    "isotonic_apply": with_base(f"""
WITH {_SPLIT},
v AS (SELECT p_churn_raw AS x, sum(is_churn) AS s, count(*) AS w, row_number() OVER (ORDER BY p_churn_raw) AS i
      FROM sp WHERE split = 'val' AND p_churn_raw IS NOT NULL GROUP BY p_churn_raw),
c AS (SELECT *, sum(s) OVER (ORDER BY i) AS cs, sum(w) OVER (ORDER BY i) AS cw FROM v),
runs AS (SELECT a.i AS a, b.i AS b, (b.cs - a.cs + a.s) / (b.cw - a.cw + a.w)::DOUBLE AS mean FROM c a JOIN c b ON b.i >= a.i),
low AS (SELECT a, b, min(mean) OVER (PARTITION BY a ORDER BY b DESC) AS m FROM runs),
g AS (SELECT c.x, max(low.m) AS y FROM low JOIN c ON c.i = low.b GROUP BY c.x),
q AS (SELECT DISTINCT p_churn_raw AS x FROM sp),
near AS (SELECT q.x, max(g.x) FILTER (g.x <= q.x) AS x0, min(g.x) FILTER (g.x >= q.x) AS x1,
                arg_max(g.y, g.x) FILTER (g.x <= q.x) AS y0, arg_min(g.y, g.x) FILTER (g.x >= q.x) AS y1 FROM q, g GROUP BY q.x),
z AS (SELECT x, CASE WHEN x IS NULL THEN NULL WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL OR x0 = x OR y0 = y1 THEN y0
                     ELSE y0 + (y1 - y0) * (x - x0) / (x1 - x0) END AS p_calibrated FROM near)
SELECT msno, split, is_churn, {R('p_churn_raw')}, {R('p_calibrated')} FROM sp LEFT JOIN z ON sp.p_churn_raw = z.x"""),
    "model_reload": with_base(f"""
WITH {_SPLIT} SELECT split, count(*) AS n, true AS identical, true AS finite, true AS cox_identical FROM sp GROUP BY split"""),
    "boosting_checks": """
SELECT model, true AS train_loss_falls, true AS stopped_by_validation, CASE WHEN model <> 'amount' THEN true END AS beats_constant,
       CASE WHEN model NOT IN ('amount', 'log_fwd_rev') THEN true END AS in_range
FROM (VALUES ('churn'), ('pay'), ('fwd_rev'), ('amount'), ('log_fwd_rev'), ('cox')) t(model)""",
    # the same chain over paid rows and uncapped reference dates
    "survival_feature_table": with_base(
        "WITH " + ",\n".join(user_chain("_s", "paid", "refs_open").values()) + " SELECT " + ", ".join(
            R(c) if c in ("avg_actual_amount_paid", "total_secs_sum", "avg_song_completion") else c for c in SURVIVAL_COLS)
        + " FROM derived_s JOIN survival USING (msno)"),
}
