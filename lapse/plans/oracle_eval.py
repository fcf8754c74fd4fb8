"""Oracle SQL for lapse.plans.q_eval (independent formulations: Mann-Whitney
AUC from average ranks, pair-join concordance, range-joined calibration bins)."""

from lapse.operators.calibration import bin_edges
from lapse.plans.oracle_base import R, with_base

N_FUNDED = 1000
Z = 1.959963984540054

_st = """st AS (SELECT p_churn_raw AS s, sum(is_churn) AS np, sum(1 - is_churn) AS nn FROM scored GROUP BY 1)"""
_cum = """cc AS (SELECT s, np, nn,
       CAST(sum(np) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS ctp,
       CAST(sum(nn) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS cfp FROM st)"""


def _reg(pred, src="scored", by=None):
    e = f"({pred} - fwd_rev)"
    sel = (f"count(*) AS n, {R(f'sqrt(avg({e} * {e}))', 6, 'rmse')}, {R(f'avg(abs({e}))', 6, 'mae')}, "
           f"{R(f'1 - avg({e} * {e}) / nullif(var_pop(fwd_rev), 0)', 6, 'r2')}, "
           f"CAST(count_if({pred} IS NULL OR NOT isfinite({pred})) AS BIGINT) AS n_nonfinite")
    if by:
        return f"SELECT {by}, {sel} FROM {src} GROUP BY 1"
    return f"SELECT {sel} FROM {src}"


def _reg_raw(pred, name):
    e = f"({pred} - fwd_rev)"
    return (f"SELECT '{name}' AS model, count(*) AS n, sqrt(avg({e} * {e})) AS rmse, avg(abs({e})) AS mae, "
            f"1 - avg({e} * {e}) / var_pop(fwd_rev) AS r2 FROM sc2")


_km = """et AS (SELECT CAST(duration_days AS BIGINT) AS t, CAST(sum(event_churned) AS BIGINT) AS events,
                   count(*) AS removed FROM survival GROUP BY 1),
c AS (SELECT *, sum(removed) OVER (ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS at_risk FROM et),
km0 AS (SELECT t, CAST(at_risk AS BIGINT) AS at_risk, events, CAST(removed - events AS BIGINT) AS censored,
               product(1.0 - events / at_risk) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS survival FROM c),
km AS (SELECT * FROM km0 UNION ALL
       SELECT CAST(0 AS BIGINT), (SELECT count(*) FROM survival), CAST(0 AS BIGINT), CAST(0 AS BIGINT), 1.0::DOUBLE
       WHERE (SELECT min(t) FROM et) > 0)"""

_rn = """rn AS (SELECT s.duration_days, s.event_churned, l.is_auto_renew FROM survival s JOIN latest_renew l USING (msno))"""

_bins = "bins AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, CAST('{lo!r}' AS DOUBLE), CAST('{hi!r}' AS DOUBLE))"
    for i, (lo, hi) in enumerate(zip(bin_edges(10)[:-1], bin_edges(10)[1:]))) + ") t(bin, bin_lo, bin_hi))"
_calg = """cx AS (SELECT s.p_churn_raw AS p, s.is_churn AS y, b.bin FROM scored s JOIN bins b
        ON s.p_churn_raw >= b.bin_lo AND (s.p_churn_raw < b.bin_hi OR (b.bin = 9 AND s.p_churn_raw <= b.bin_hi))),
cg AS (SELECT bin, count(*) AS n, avg(p) AS conf, avg(y) AS acc FROM cx GROUP BY bin),
cb AS (SELECT CAST(b.bin AS BIGINT) AS bin, b.bin_lo, b.bin_hi, coalesce(cg.n, 0) AS n, cg.conf, cg.acc
       FROM bins b LEFT JOIN cg USING (bin))"""

_SEGS = (("high", "high", "Immediate: personal outreach, premium discount"),
         ("high", "low", "Low priority: automated email only"),
         ("low", "high", "Monitor: no immediate action needed"),
         ("medium", "medium", "Queue for weekly retention campaign"),
         ("low", "low", "No action: below cost-of-retention threshold"))
_segvals = ", ".join(f"('{r}', '{v}', '{a}')" for r, v, a in _SEGS)


def _lvl(col, lo, hi, which):
    return (f"(CASE {which} WHEN 'low' THEN {col} < {lo} WHEN 'high' THEN {col} > {hi} "
            f"ELSE {col} BETWEEN {lo} AND {hi} END)")


_budget = f"""bud AS (SELECT count(*) AS n_test_users, CAST(sum(is_churn) AS BIGINT) AS n_actual_churners,
       coalesce(sum(priority_score * 0.3) FILTER (WHERE rank <= {N_FUNDED}), 0.0) AS revenue_model,
       coalesce(sum(priority_score * 0.3) FILTER (WHERE rank_random <= {N_FUNDED}), 0.0) AS revenue_random,
       coalesce(sum(priority_score * 0.3) FILTER (WHERE rank_churn <= {N_FUNDED}), 0.0) AS revenue_churn_only
  FROM (SELECT *, row_number() OVER (ORDER BY p_churn DESC, msno) AS rank_churn,
               row_number() OVER (ORDER BY md5('42:' || CAST(msno AS VARCHAR)), msno) AS rank_random
        FROM results))"""

_logrank = f"""
WITH {_rn},
x AS (SELECT duration_days AS t, event_churned AS e, CASE WHEN is_auto_renew = 1 THEN 1 ELSE 0 END AS g FROM rn),
tt AS (SELECT t, CAST(sum(e) AS DOUBLE) AS d, CAST(count(*) AS DOUBLE) AS r, CAST(sum(e * g) AS DOUBLE) AS d1,
              CAST(sum(g) AS DOUBLE) AS r1 FROM x GROUP BY t),
w AS (SELECT *, sum(r) OVER (ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS n,
             sum(r1) OVER (ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS n1 FROM tt),
agg AS (SELECT sum(d1 - d * n1 / n) AS ome,
               sum(CASE WHEN n > 1 THEN d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1) ELSE 0.0 END) AS v,
               sum(d1) AS o1, sum(d * n1 / n) AS e1 FROM w)
"""
_logrank_row = f"""SELECT {R('ome', 6, 'o_minus_e')}, {R('v', 6, 'variance')}, CAST(o1 AS BIGINT) AS observed_1, {R('e1', 6, 'expected_1')},
       {R('ome * ome / v', 6, 'chi2')}"""

ORACLE = {
    "auc_roc": with_base(f"""
WITH rr AS (SELECT is_churn, rank() OVER (ORDER BY p_churn_raw)
                   + (count(*) OVER (PARTITION BY p_churn_raw) - 1) / 2.0 AS rk FROM scored),
s AS (SELECT sum(rk) FILTER (WHERE is_churn = 1) AS sr, CAST(count_if(is_churn = 1) AS BIGINT) AS n_pos,
             CAST(count_if(is_churn = 0) AS BIGINT) AS n_neg FROM rr)
SELECT {R('(sr - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg)', 6, 'auc_roc')}, n_pos, n_neg,
       (SELECT CAST(count_if(p_churn_raw IS NULL) AS BIGINT) FROM scored) AS n_left_out FROM s"""),
    "average_precision": with_base(f"""
WITH {_st}, {_cum}
SELECT {R('sum(np * ctp / (ctp + cfp)) / sum(np)', 6, 'average_precision')},
       (SELECT CAST(count_if(p_churn_raw IS NULL) AS BIGINT) FROM scored) AS n_left_out FROM cc"""),
    "roc_curve": with_base(f"""
WITH {_st}, {_cum}, tot AS (SELECT CAST(sum(np) AS DOUBLE) AS P, CAST(sum(nn) AS DOUBLE) AS N FROM st)
SELECT CAST(NULL AS DOUBLE) AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr
UNION ALL SELECT {R('s', 6, 'threshold')}, {R('cfp / N', 6, 'fpr')}, {R('ctp / P', 6, 'tpr')} FROM cc, tot"""),
    "pr_curve": with_base(f"""
WITH {_st}, {_cum}, tot AS (SELECT CAST(sum(np) AS DOUBLE) AS P, CAST(sum(np + nn) AS DOUBLE) AS N FROM st)
SELECT threshold, precision, recall, {R('P / N', 6, 'base_rate')} FROM (
  SELECT {R('s', 6, 'threshold')}, {R('ctp / (ctp + cfp)', 6, 'precision')}, {R('ctp / P', 6, 'recall')} FROM cc, tot
  UNION ALL SELECT CAST(NULL AS DOUBLE), 1.0::DOUBLE, 0.0::DOUBLE) x, tot"""),
    "regression_metrics": with_base(_reg("e_fwd_rev")),
    "metrics_by_payer": with_base(
        "WITH sp AS (SELECT *, CAST(CASE WHEN fwd_rev > 0 THEN 1 ELSE 0 END AS BIGINT) AS is_payer FROM scored) "
        + _reg("e_fwd_rev", "sp", "is_payer")),
    "ceiling_metrics": with_base(
        "WITH sc2 AS (SELECT *, CASE WHEN fwd_rev > 0 THEN e_amount ELSE 0.0 END AS pred_ceiling FROM scored) "
        + _reg("pred_ceiling", "sc2")),
    "model_comparison": with_base(f"""
WITH sc2 AS (SELECT *, CASE WHEN fwd_rev > 0 THEN e_amount ELSE 0.0 END AS pred_ceiling, 0.0 AS pred_zero FROM scored),
m AS ({_reg_raw('e_fwd_rev', 'hurdle')} UNION ALL {_reg_raw('pred_ceiling', 'ceiling')}
      UNION ALL {_reg_raw('pred_zero', 'zero')} UNION ALL {_reg_raw('e_amount', 'last_amount')})
SELECT model, n, {R('rmse')}, {R('mae')}, {R('r2')},
       CAST(rmse = min(rmse) OVER () AS BIGINT) AS best_rmse, CAST(mae = min(mae) OVER () AS BIGINT) AS best_mae,
       CAST(r2 = max(r2) OVER () AS BIGINT) AS best_r2 FROM m"""),
    "prediction_sample": with_base(f"""
SELECT msno, {R('fwd_rev')}, {R('e_fwd_rev')} FROM scored
ORDER BY md5('pairs:42:' || CAST(msno AS VARCHAR)) LIMIT 20000"""),
    "concordance": with_base(f"""
WITH ss AS (SELECT s.duration_days AS d, s.event_churned AS e, coalesce(cs.p_churn_raw, 0.0) AS sc
            FROM survival s LEFT JOIN cust_score cs USING (msno)),
pr AS (SELECT CASE WHEN j.sc > i.sc THEN 1 ELSE 0 END AS c, CASE WHEN j.sc = i.sc THEN 1 ELSE 0 END AS t,
              CASE WHEN j.sc < i.sc THEN 1 ELSE 0 END AS dd
       FROM ss i JOIN ss j ON i.e = 1 AND (j.d > i.d OR (j.d = i.d AND j.e = 0)))
SELECT CAST(sum(c) AS BIGINT) AS concordant, CAST(sum(t) AS BIGINT) AS tied, CAST(sum(dd) AS BIGINT) AS discordant,
       count(*) AS comparable_pairs, {R('(sum(c) + 0.5 * sum(t)) / count(*)', 6, 'c_index')}, CAST(0 AS BIGINT) AS n_left_out FROM pr"""),
    "tie_structure": with_base("""
SELECT count(*) AS n_distinct, max(c) AS largest_tie_group, CAST(sum(c) AS BIGINT) AS n_rows
FROM (SELECT p_churn_raw, count(*) AS c FROM scored GROUP BY 1)"""),
    "funded_tie_structure": with_base(f"""
SELECT count(*) AS n_distinct, max(c) AS largest_tie_group, CAST(sum(c) AS BIGINT) AS n_rows
FROM (SELECT p_churn_raw, count(*) AS c FROM results WHERE rank <= {N_FUNDED} GROUP BY 1)"""),
    "kaplan_meier": with_base(f"""
WITH {_km}
SELECT t, at_risk, events, censored, {R('survival')} FROM km"""),
    "kaplan_meier_by_renew": with_base(f"""
WITH {_rn},
et AS (SELECT is_auto_renew, CAST(duration_days AS BIGINT) AS t, CAST(sum(event_churned) AS BIGINT) AS events,
              count(*) AS removed FROM rn GROUP BY 1, 2),
c AS (SELECT *, sum(removed) OVER (PARTITION BY is_auto_renew ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS at_risk FROM et),
km AS (SELECT is_auto_renew, t, CAST(at_risk AS BIGINT) AS at_risk, events, CAST(removed - events AS BIGINT) AS censored,
              product(1.0 - events / at_risk) OVER (PARTITION BY is_auto_renew ORDER BY t ROWS UNBOUNDED PRECEDING)
              AS survival FROM c)
SELECT is_auto_renew, t, at_risk, events, censored, {R('survival')} FROM km
UNION ALL
SELECT is_auto_renew, CAST(0 AS BIGINT), CAST(sum(removed) AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), 1.0::DOUBLE
FROM et GROUP BY is_auto_renew HAVING min(t) > 0"""),
    "survival_horizons": with_base(f"""
WITH {_km}
SELECT min(t) FILTER (WHERE survival <= 0.5) AS median_survival,
       {', '.join(R(f'arg_max(survival, t) FILTER (WHERE t <= {h})', 6, f's_{h}') for h in (30, 90, 180, 365, 730))}
FROM km"""),
    "kaplan_meier_ci": with_base(f"""
WITH {_km},
g AS (SELECT *, sum(CASE WHEN at_risk > events THEN events / (at_risk * (at_risk - events)) END)
                OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS greenwood FROM km)
SELECT t, at_risk, events, censored, {R('survival')}, {R('greenwood')},
       {R(f'CASE WHEN survival = 1 THEN 1.0 WHEN survival > 0 AND survival < 1 AND greenwood IS NOT NULL '
          f'THEN exp(-exp(ln(-ln(survival)) - {Z} * sqrt(greenwood) / ln(survival))) END', 6, 'ci_lower')},
       {R(f'CASE WHEN survival = 1 THEN 1.0 WHEN survival > 0 AND survival < 1 AND greenwood IS NOT NULL '
          f'THEN exp(-exp(ln(-ln(survival)) + {Z} * sqrt(greenwood) / ln(survival))) END', 6, 'ci_upper')}
FROM g"""),
    "logrank": with_base(_logrank + _logrank_row + " FROM agg"),
    # P(chi2 > x) = 1 - erf(z) at z^2 = x / 2; erf by its series, 0 beyond what a double tells
    "logrank_test": with_base(_logrank + _logrank_row + f""",
       {R("""CASE WHEN ome * ome / v > 60 THEN 0.0 ELSE 1.0 - exp(-ome * ome / v / 2) * (
            SELECT sum(pow(sqrt(ome * ome / v / 2), 2 * k + 1) / gamma(k + 1.5)) FROM range(150) g(k)) END""", 6, 'p_value')} FROM agg"""),
    "calibration_bins": with_base(f"""
WITH {_bins}, {_calg}
SELECT bin, {R('bin_lo')}, {R('bin_hi')}, n, {R('conf', 6, 'avg_confidence')}, {R('acc', 6, 'avg_accuracy')} FROM cb"""),
    "ece": with_base(f"""
WITH {_bins}, {_calg}
SELECT {R('sum(CASE WHEN n > 0 THEN n / (SELECT count(*) FROM scored) * abs(conf - acc) END)', 6, 'ece')},
       CAST(sum(n) AS BIGINT) AS n_binned, (SELECT count(*) FROM scored) AS n FROM cb"""),
    "reliability_points": with_base(f"""
WITH {_bins}, {_calg}
SELECT bin, {R('(bin_lo + bin_hi) / 2', 6, 'midpoint')}, {R('conf', 6, 'avg_confidence')},
       {R('acc', 6, 'avg_accuracy')} FROM cb WHERE n > 0"""),
    "calibration_summary": with_base(f"""
SELECT count(*) AS n, {R('avg(is_churn)', 6, 'true_rate')}, {R('avg(p_churn_raw)', 6, 'mean_p_churn_raw')}
FROM scored"""),
    "churn_percentile": with_base(f"SELECT msno, {R('p_churn_raw')}, {R('p_churn')} FROM results"),
    "priority_scores": with_base(f"""
SELECT msno, is_churn, {R('p_churn_raw')}, {R('e_fwd_rev')}, {R('p_churn')}, {R('priority_score')},
       CAST(rank AS BIGINT) AS rank FROM results"""),
    "segment_examples": with_base(f"""
WITH q AS (SELECT quantile_cont(p_churn, 0.33) AS p_lo, quantile_cont(p_churn, 0.67) AS p_hi,
                  quantile_cont(e_fwd_rev, 0.33) AS v_lo, quantile_cont(e_fwd_rev, 0.67) AS v_hi FROM results),
segs AS (SELECT * FROM (VALUES {_segvals}) t(risk, val, action)),
seg AS (SELECT r.*, s.risk || '-risk, ' || s.val || '-value' AS segment, s.action
        FROM results r, q, segs s
        WHERE {_lvl('r.p_churn', 'q.p_lo', 'q.p_hi', 's.risk')} AND {_lvl('r.e_fwd_rev', 'q.v_lo', 'q.v_hi', 's.val')}),
med AS (SELECT segment, quantile_cont(priority_score, 0.5) AS m FROM seg GROUP BY 1),
pick AS (SELECT seg.*, row_number() OVER (PARTITION BY segment ORDER BY abs(priority_score - m), rank) AS rn
         FROM seg JOIN med USING (segment))
SELECT segment, {R('p_churn', 6, 'p_churn_percentile')}, {R('p_churn_raw')}, {R('e_fwd_rev', 6, 'e_fwd_rev_twd')},
       {R('priority_score')}, action AS recommended_action FROM pick WHERE rn = 1"""),
    "budget_allocation": with_base(f"""
WITH {_budget}
SELECT n_test_users, n_actual_churners, {R('revenue_model')}, {R('revenue_random')}, {R('revenue_churn_only')},
       CAST({N_FUNDED} AS BIGINT) AS n_interventions,
       {R(f'{N_FUNDED} * 100.0 / n_test_users', 6, 'coverage_of_test_set_pct')},
       {R(f'{N_FUNDED} * 100.0 / n_actual_churners', 6, 'coverage_of_at_risk_pct')},
       {R('(revenue_model / revenue_random - 1) * 100', 6, 'model_vs_random_pct')},
       {R('(revenue_model / revenue_churn_only - 1) * 100', 6, 'model_vs_churn_only_pct')} FROM bud"""),
    "strategy_table": with_base(f"""
WITH {_budget}
SELECT 'model ranking' AS strategy, {R('revenue_model', 6, 'revenue')}, {R('100.0', 6, 'pct_of_model')} FROM bud
UNION ALL SELECT 'random', {R('revenue_random', 6, 'revenue')}, {R('revenue_random / revenue_model * 100', 6, 'pct_of_model')} FROM bud
UNION ALL SELECT 'churn probability only', {R('revenue_churn_only', 6, 'revenue')},
          {R('revenue_churn_only / revenue_model * 100', 6, 'pct_of_model')} FROM bud"""),
    "rank_sensitivity": with_base(f"""
WITH s AS (SELECT *, least(greatest(p_churn * 1.1, 0.0), 1.0) * e_fwd_rev AS su,
                     least(greatest(p_churn * 0.9, 0.0), 1.0) * e_fwd_rev AS sl FROM results),
rr AS (SELECT *, rank() OVER (ORDER BY su DESC) + (count(*) OVER (PARTITION BY su) - 1) / 2.0 AS ru,
                 rank() OVER (ORDER BY sl DESC) + (count(*) OVER (PARTITION BY sl) - 1) / 2.0 AS rl FROM s),
top AS (SELECT *, abs(ru - rl) AS delta FROM rr WHERE rank <= {N_FUNDED})
SELECT {R('quantile_cont(delta, 0.5)', 6, 'median_rank_delta')},
       CAST(count_if(delta > {N_FUNDED}) AS BIGINT) AS n_borderline,
       {R(f'avg(CASE WHEN delta > {N_FUNDED} THEN 1.0 ELSE 0.0 END) * 100', 6, 'pct_borderline')},
       count(*) AS n_top,
       (SELECT count(DISTINCT p_churn_raw) FROM top) AS n_distinct_p_churn_raw_top_k,
       (SELECT max(c) FROM (SELECT count(*) AS c FROM top GROUP BY p_churn_raw)) AS largest_tie_group_top_k
FROM top"""),
}
