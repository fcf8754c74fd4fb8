"""Metric, survival, calibration and decision-layer queries (K, L, M, N, F2-F4, H9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapse.operators import calibration as cal
from lapse.operators import decision as dec
from lapse.operators import features as fe
from lapse.operators import metrics as met
from lapse.operators import ranking as rk
from lapse.operators import survival as sv
from lapse.plans.context import rnd
from lapse.session import materialize
from lapse.plans.registry import query
from lapse.sources import adapters

# The reference's budget simulation.
BUDGET, VOUCHER_COST, SUCCESS_RATE = 50_000, 50, 0.30
# Fixed value: size of the exported prediction sample.
SAMPLE_ROWS = 20_000
HORIZONS = (30, 90, 180, 365, 730)


def results(ctx):
    if not hasattr(ctx, "_results"):
        ctx._results = materialize(dec.priority_scores(ctx.scored))
    return ctx._results


@query("auc_roc")
def auc_roc(ctx):
    return rnd(met.auc_roc(ctx.scored, "p_churn_raw", "is_churn"))


@query("average_precision")
def average_precision(ctx):
    return rnd(met.average_precision(ctx.scored, "p_churn_raw", "is_churn"))


@query("roc_curve")
def roc_curve(ctx):
    return rnd(met.roc_curve(ctx.scored, "p_churn_raw", "is_churn"))


@query("pr_curve")
def pr_curve(ctx):
    return rnd(met.pr_curve(ctx.scored, "p_churn_raw", "is_churn"))


@query("regression_metrics")
def regression_metrics(ctx):
    return rnd(met.regression_metrics(ctx.scored, "e_fwd_rev", "fwd_rev"))


@query("metrics_by_payer")
def metrics_by_payer(ctx):
    s = ctx.scored.withColumn("is_payer", (F.col("fwd_rev") > 0).cast("bigint"))
    return rnd(met.regression_metrics(s, "e_fwd_rev", "fwd_rev", by=["is_payer"]))


def _ceiling(ctx):
    return ctx.scored.withColumn("pred_ceiling", F.when(F.col("fwd_rev") > 0, F.col("e_amount"))
                                 .otherwise(F.lit(0.0)))


@query("ceiling_metrics")
def ceiling_metrics(ctx):
    return rnd(met.regression_metrics(_ceiling(ctx), "pred_ceiling", "fwd_rev"))


@query("model_comparison")
def model_comparison(ctx):
    s = _ceiling(ctx).withColumn("pred_zero", F.lit(0.0))
    rows = [met.regression_metrics(s, col, "fwd_rev").select(F.lit(name).alias("model"), "n", "rmse", "mae", "r2")
            for name, col in (("hurdle", "e_fwd_rev"), ("ceiling", "pred_ceiling"),
                              ("zero", "pred_zero"), ("last_amount", "e_amount"))]
    return rnd(met.compare_models(rows))


@query("prediction_sample")
def prediction_sample(ctx):
    return rnd(met.sample_pairs(ctx.scored.select("msno", "fwd_rev", "e_fwd_rev"), "msno", SAMPLE_ROWS, ctx.p.seed))


def _surv_scored(ctx):
    return ctx.survival.join(adapters.customer_score(ctx.t("customer")), "msno", "left") \
        .withColumn("p_churn_raw", F.coalesce(F.col("p_churn_raw"), F.lit(0.0)))


@query("concordance")
def concordance(ctx):
    return rnd(met.concordance_pairs(_surv_scored(ctx), "duration_days", "event_churned", "p_churn_raw"))


@query("tie_structure")
def tie_structure(ctx):
    return rnd(dec.tie_structure(ctx.scored, "p_churn_raw"))


@query("funded_tie_structure")
def funded_tie_structure(ctx):
    n = BUDGET // VOUCHER_COST
    return rnd(dec.tie_structure(results(ctx).filter(F.col("rank") <= n), "p_churn_raw"))


@query("kaplan_meier")
def kaplan_meier(ctx):
    return rnd(sv.kaplan_meier(ctx.survival, "duration_days", "event_churned"))


def _with_renew(ctx):
    latest = fe.latest_per(ctx.paid, "msno", ["txn_dt", "txn_id"], ["is_auto_renew"])
    return ctx.survival.join(latest, "msno")


@query("kaplan_meier_by_renew")
def kaplan_meier_by_renew(ctx):
    return rnd(sv.kaplan_meier(_with_renew(ctx), "duration_days", "event_churned", by=["is_auto_renew"]))


@query("survival_horizons")
def survival_horizons(ctx):
    curve = sv.kaplan_meier(ctx.survival, "duration_days", "event_churned")
    return rnd(sv.survival_at(curve, HORIZONS))


@query("kaplan_meier_ci")
def kaplan_meier_ci(ctx):
    return rnd(sv.kaplan_meier(ctx.survival, "duration_days", "event_churned", ci=True))


@query("logrank")
def logrank(ctx):
    return rnd(sv.logrank(_with_renew(ctx), "duration_days", "event_churned", "is_auto_renew"))


@query("logrank_test")
def logrank_test(ctx):
    return rnd(sv.logrank_pvalue(sv.logrank(_with_renew(ctx), "duration_days", "event_churned", "is_auto_renew")))


@query("calibration_bins")
def calibration_bins(ctx):
    return rnd(cal.calibration_bins(ctx.scored, "p_churn_raw", "is_churn"))


@query("ece")
def ece(ctx):
    return rnd(cal.ece(ctx.scored, "p_churn_raw", "is_churn"))


@query("reliability_points")
def reliability_points(ctx):
    return rnd(cal.reliability(ctx.scored, "p_churn_raw", "is_churn"))


@query("calibration_summary")
def calibration_summary(ctx):
    return rnd(cal.calibration_summary(ctx.scored, ["p_churn_raw"], "is_churn"))


@query("churn_percentile")
def churn_percentile(ctx):
    return rnd(rk.pct_rank(ctx.scored.select("msno", "p_churn_raw"), "p_churn_raw", "p_churn"))


@query("priority_scores")
def priority_scores(ctx):
    return rnd(results(ctx).select("msno", "is_churn", "p_churn_raw", "e_fwd_rev", "p_churn",
                                   "priority_score", "rank"))


@query("segment_examples")
def segment_examples(ctx):
    return rnd(dec.segment_examples(results(ctx)))


def _budget(ctx):
    return dec.budget_allocation(results(ctx), BUDGET, VOUCHER_COST, SUCCESS_RATE, ctx.p.seed)


@query("budget_allocation")
def budget_allocation(ctx):
    return rnd(_budget(ctx))


@query("strategy_table")
def strategy_table(ctx):
    return rnd(dec.strategy_table(_budget(ctx)))


@query("rank_sensitivity")
def rank_sensitivity(ctx):
    _, summary = dec.rank_sensitivity(results(ctx), BUDGET // VOUCHER_COST)
    return rnd(summary)
