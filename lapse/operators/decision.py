"""Business decision layer (N1-N8): priority, segments, budget, sensitivity.

Ranks are global and exact (``ranking``); selections of the n best are
``rank <= n`` filters, so no top-n ever passes through a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapse.functions.exprs import safe_div
from lapse.operators.metrics import hash_order
from lapse.operators.ranking import avg_rank, join_small, pct_rank, quantiles, row_rank
from lapse.session import materialize

# The five illustrated segments (risk, value, recommended action).
SEGMENTS = (
    ("high", "high", "Immediate: personal outreach, premium discount"),
    ("high", "low", "Low priority: automated email only"),
    ("low", "high", "Monitor: no immediate action needed"),
    ("medium", "medium", "Queue for weekly retention campaign"),
    ("low", "low", "No action: below cost-of-retention threshold"),
)


def priority_scores(df: DataFrame, key: str = "msno", p_raw: str = "p_churn_raw",
                    value: str = "e_fwd_rev") -> DataFrame:
    """p_churn = percentile rank of the calibrated probability (ties averaged),
    priority = p_churn * expected revenue, rank = 1.. by priority desc, key asc (N1)."""
    r = pct_rank(df, p_raw, "p_churn")
    r = r.withColumn("priority_score", F.col("p_churn") * F.col(value))
    return row_rank(r, ["priority_score desc", key], "rank")


def _level(col, lo, hi, level):
    c = F.col(col)
    if level == "low":
        return c < lo
    if level == "high":
        return c > hi
    return c.between(lo, hi)


def segment_examples(results: DataFrame, segments=SEGMENTS) -> DataFrame:
    """Per segment (low/medium/high by the .33/.67 quantiles of p_churn and
    e_fwd_rev; strict outside, inclusive middle) the user nearest to the
    segment's median priority (ties: better rank) (N2).  Empty segment: no row."""
    # the four thresholds are fitted statistics: computed once, used as literals
    lv = results.select(F.lit("p").alias("c"), F.col("p_churn").cast("double").alias("v")).unionByName(
        results.select(F.lit("v").alias("c"), F.col("e_fwd_rev").cast("double").alias("v")))
    th = {(r["c"], r["p"]): r["q"] for r in quantiles(lv, "v", [0.33, 0.67], by=["c"]).collect()}
    p_lo, p_hi, v_lo, v_hi = (F.lit(th.get(k)).cast("double")
                              for k in (("p", 0.33), ("p", 0.67), ("v", 0.33), ("v", 0.67)))
    # a user can fall into several of the listed segments only if they overlap;
    # the five listed do not, but build membership as an array to stay general
    arr = F.array_compact(F.array(*[
        F.when(_level("p_churn", p_lo, p_hi, r) & _level("e_fwd_rev", v_lo, v_hi, v),
               F.struct(F.lit(f"{r}-risk, {v}-value").alias("segment"), F.lit(a).alias("action")))
        for r, v, a in segments]))
    m = results.select("*", F.explode(arr).alias("_s")).select("*", "_s.segment", "_s.action").drop("_s")
    m = materialize(m)
    med = quantiles(m, "priority_score", [0.5], by=["segment"]).select("segment", F.col("q").alias("_median"))
    j = join_small(m, med, ["segment"]).withColumn("_d", F.abs(F.col("priority_score") - F.col("_median")))
    # nearest distance per segment (hash aggregate, one row per segment), then
    # only the rows at that distance choose the better rank
    best = j.groupBy("segment").agg(F.min("_d").alias("_dmin"))
    near = join_small(j, best, ["segment"]).filter(F.col("_d") == F.col("_dmin"))
    pick = F.min_by(F.struct("p_churn", "p_churn_raw", "e_fwd_rev", "priority_score", "action"), F.col("rank"))
    return near.groupBy("segment").agg(pick.alias("_x")).select(
        "segment", F.col("_x.p_churn").alias("p_churn_percentile"), F.col("_x.p_churn_raw").alias("p_churn_raw"),
        F.col("_x.e_fwd_rev").alias("e_fwd_rev_twd"), F.col("_x.priority_score").alias("priority_score"),
        F.col("_x.action").alias("recommended_action"))


def top_n(df: DataFrame, order_cols, n: int) -> DataFrame:
    """The n first rows of a total order (G2): a filter on the distributed rank."""
    return row_rank(df, order_cols, "_r").filter(F.col("_r") <= n).drop("_r")


def budget_allocation(results: DataFrame, budget: int, cost: int, success_rate: float,
                      seed: int = 42, key: str = "msno") -> DataFrame:
    """Model ranking vs random vs churn-only under one expected-value formula.
    n = budget // cost; random order = md5(seed:key); churn-only = p_churn desc, key."""
    n = budget // cost

    def saved(sel: DataFrame):
        return sel.select(F.coalesce(F.sum(F.col("priority_score") * success_rate), F.lit(0.0))).scalar()

    random_sel = top_n(results.withColumn("_h", hash_order(key, seed)), ["_h", key], n)
    churn_sel = top_n(results, ["p_churn desc", key], n)
    out = results.agg(
        F.count(F.lit(1)).alias("n_test_users"),
        F.sum(F.col("is_churn").cast("bigint")).alias("n_actual_churners"),
        F.coalesce(F.sum(F.when(F.col("rank") <= n, F.col("priority_score") * success_rate)), F.lit(0.0))
         .alias("revenue_model"),
        saved(random_sel).alias("revenue_random"),
        saved(churn_sel).alias("revenue_churn_only"))
    return (out.withColumn("n_interventions", F.lit(n).cast("bigint"))
            .withColumn("coverage_of_test_set_pct", safe_div(F.lit(n * 100.0), F.col("n_test_users")))
            .withColumn("coverage_of_at_risk_pct", safe_div(F.lit(n * 100.0), F.col("n_actual_churners")))
            .withColumn("model_vs_random_pct", (safe_div(F.col("revenue_model"), F.col("revenue_random")) - 1) * 100)
            .withColumn("model_vs_churn_only_pct",
                        (safe_div(F.col("revenue_model"), F.col("revenue_churn_only")) - 1) * 100))


def strategy_table(budget_row: DataFrame) -> DataFrame:
    """Unpivot of the budget comparison: strategy, revenue, % of the model's value.
    The row is computed once."""
    names = {"model ranking": "revenue_model", "random": "revenue_random", "churn probability only": "revenue_churn_only"}
    parts = F.array(*[F.struct(F.lit(k).alias("strategy"), F.col(c).alias("revenue")) for k, c in names.items()])
    return budget_row.select("revenue_model", F.explode(parts).alias("x")).select(
        "x.strategy", "x.revenue", (safe_div(F.col("x.revenue"), F.col("revenue_model")) * 100).alias("pct_of_model"))


def rank_sensitivity(results: DataFrame, n: int, perturbation: float = 0.10) -> tuple[DataFrame, DataFrame]:
    """Perturb p_churn by +-perturbation (clipped to [0, 1]), re-rank with
    average ranks (descending), |delta| per user; summary over the top n (N6).

    Both variants are ranked in one long frame (variant, value)."""
    def clip01(c):
        return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))

    def score(sign):
        return clip01(F.col("p_churn") * (1 + sign * perturbation)) * F.col("e_fwd_rev")

    keyed = materialize(results.withColumn("score_upper", score(1)).withColumn("score_lower", score(-1)))
    parts = F.array(*[F.struct(F.lit(k).alias("variant"), F.col(f"score_{k}").alias("value")) for k in ("upper", "lower")])
    long = keyed.select("rank", F.explode(parts).alias("x")).select("rank", "x.variant", "x.value")
    ranked = avg_rank(long, "value", "avg", descending=True, by=["variant"])
    wide = ranked.groupBy("rank").agg(*[F.max(F.when(F.col("variant") == k, F.col("avg"))).alias(f"rank_{k}")
                                        for k in ("upper", "lower")])
    r = materialize(keyed.join(wide, "rank").withColumn("rank_delta", F.abs(F.col("rank_upper") - F.col("rank_lower"))))
    top = r.filter(F.col("rank") <= n)
    med = quantiles(top, "rank_delta", [0.5]).select("q").scalar()
    ties = top.groupBy("p_churn_raw").agg(F.count(F.lit(1)).alias("_c"))
    groups = ties.agg(F.count(F.lit(1)).alias("n_distinct_p_churn_raw_top_k"), F.max("_c").alias("largest_tie_group_top_k"))
    summary = top.agg(
        F.count_if(F.col("rank_delta") > n).alias("n_borderline"),
        (F.avg(F.when(F.col("rank_delta") > n, 1.0).otherwise(0.0)) * 100).alias("pct_borderline"),
        F.count(F.lit(1)).alias("n_top"),
    ).select(F.lit(med).alias("median_rank_delta"), "*",
             *[groups.select(c).scalar().alias(c) for c in ("n_distinct_p_churn_raw_top_k", "largest_tie_group_top_k")])
    return r, summary


def tie_structure(df: DataFrame, col: str) -> DataFrame:
    """Distinct values and the largest tie group."""
    g = df.groupBy(col).agg(F.count(F.lit(1)).alias("_c"))
    return g.agg(F.count(F.lit(1)).alias("n_distinct"), F.max("_c").alias("largest_tie_group"),
                 F.sum("_c").alias("n_rows"))
