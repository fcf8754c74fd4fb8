"""Model metrics (K1-K11), exact under ties and distributed.

Classification metrics work on the distinct-score table (ties collapsed by a
``groupBy``), ordered with ``ranking.cumulative``; regression metrics are one
aggregate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapse.functions.exprs import safe_div
from lapse.operators.ranking import cumulative, row_rank
from lapse.session import materialize


def score_table(df: DataFrame, score: str, label: str) -> DataFrame:
    """(score, n_pos, n_neg) per distinct score."""
    y = F.col(label).cast("bigint")
    return (df.filter(F.col(score).isNotNull()).groupBy(score)
            .agg(F.sum(y).alias("n_pos"), F.sum(F.lit(1) - y).alias("n_neg")))


def left_out(df: DataFrame, *cols: str):
    """The number of rows that a metric leaves out because one of ``cols`` is NULL, a scalar subquery."""
    lost = F.lit(False)
    for c in cols:
        lost = lost | F.col(c).isNull()
    return df.select(F.count_if(lost)).scalar().cast("bigint").alias("n_left_out")


def _desc_curve(df, score, label):
    st = score_table(df, score, label)
    return cumulative(st, [f"{score} desc"], ["n_pos", "n_neg"])


def auc_roc(df: DataFrame, score: str, label: str) -> DataFrame:
    """ROC AUC with ties counted as one half (K1); rows without a score are counted in n_left_out."""
    st = score_table(df, score, label)
    c = cumulative(st, [score], ["n_neg"])
    below = F.col("cum_n_neg") - F.col("n_neg")
    return c.agg(
        safe_div(F.sum(F.col("n_pos") * (below + F.col("n_neg") / 2.0)),
                 F.sum("n_pos") * F.sum("n_neg")).alias("auc_roc"),
        F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg")).select("*", left_out(df, score))


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    """Step-wise average precision: sum over thresholds of (R_k - R_k-1) * P_k (K2); rows without a score are counted in n_left_out."""
    c = _desc_curve(df, score, label)
    prec = F.col("cum_n_pos") / (F.col("cum_n_pos") + F.col("cum_n_neg"))
    return c.agg(safe_div(F.sum(F.col("n_pos") * prec), F.sum("n_pos")).alias("average_precision")).select("*", left_out(df, score))


def roc_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """All ROC points by decreasing threshold, plus the (0, 0) start (threshold NULL) (K3).
    Rows without a score are in neither the points nor the totals."""
    c = materialize(_desc_curve(df, score, label))
    P, N = (c.select(F.max(x)).scalar() for x in ("cum_n_pos", "cum_n_neg"))
    pts = c.select(F.col(score).cast("double").alias("threshold"),
                   safe_div(F.col("cum_n_neg"), N).alias("fpr"), safe_div(F.col("cum_n_pos"), P).alias("tpr"))
    start = df.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"),
                                            F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return start.unionByName(pts)


def pr_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """Precision / recall per threshold, the (recall 0, precision 1) end point
    (threshold NULL) and the base rate (K4), over the rows that have a score."""
    c = materialize(_desc_curve(df, score, label))
    P, N = (c.select(F.max(x)).scalar() for x in ("cum_n_pos", "cum_n_neg"))
    pts = c.select(F.col(score).cast("double").alias("threshold"),
                   (F.col("cum_n_pos") / (F.col("cum_n_pos") + F.col("cum_n_neg"))).alias("precision"),
                   safe_div(F.col("cum_n_pos"), P).alias("recall"))
    end = df.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"),
                                          F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return pts.unionByName(end).withColumn("base_rate", safe_div(P, P + N))


def regression_metrics(df: DataFrame, pred: str, true: str, by=()) -> DataFrame:
    """RMSE / MAE / R2 on the raw scale plus a non-finite prediction count.
    Where a prediction is NULL, NaN or infinite the metrics are NULL: they never cover
    a part of the rows only."""
    p, y = F.col(pred).cast("double"), F.col(true).cast("double")
    broken = p.isNull() | F.isnan(p) | (F.abs(p) == float("inf"))
    e = F.when(~broken, p - y)
    whole = F.count_if(broken) == 0
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.when(whole, F.sqrt(F.avg(e * e))).alias("rmse"),
        F.when(whole, F.avg(F.abs(e))).alias("mae"),
        F.when(whole, F.lit(1.0) - safe_div(F.avg(e * e), F.var_pop(y))).alias("r2"),
        F.count_if(broken).alias("n_nonfinite"))


def require_finite(df: DataFrame, col: str) -> DataFrame:
    """``df``; evaluating it fails at the first NULL, NaN or infinite value of ``col`` (K7)."""
    c = F.col(col).cast("double")
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return df.withColumn(col, F.when(bad, F.raise_error(F.lit(f"{col} is not finite")).cast("double")).otherwise(F.col(col)))


def compare_models(metric_rows: list[DataFrame]) -> DataFrame:
    """Union of per-model metric rows with the best value per column flagged (K8).
    The table has one row per model, so the unpartitioned window is tiny."""
    t = reduce(DataFrame.unionByName, metric_rows)
    w = Window.partitionBy()
    return (t.withColumn("best_rmse", (F.col("rmse") == F.min("rmse").over(w)).cast("bigint"))
            .withColumn("best_mae", (F.col("mae") == F.min("mae").over(w)).cast("bigint"))
            .withColumn("best_r2", (F.col("r2") == F.max("r2").over(w)).cast("bigint")))


def hash_order(key, seed: int | str):
    """Reproducible pseudo-random order: md5 of 'seed:key' (same in DuckDB)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def hash_uniform(key, seed: int | str):
    """Uniform [0, 1) from the first 32 bits of md5('seed:key')."""
    return F.conv(F.substring(hash_order(key, seed), 1, 8), 16, 10).cast("double") / 4294967296.0


def sample_pairs(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Seeded sample of n rows (K9): the n smallest hash values, a filter on the distributed rank.  The hash is salted by
    the operator's name, so the sample is independent of a split with the same seed."""
    ranked = row_rank(df.withColumn("_h", hash_order(key, f"pairs:{seed}")), ["_h", key], "_r")
    return ranked.filter(F.col("_r") <= n).drop("_h", "_r")


def concordance_pairs(df: DataFrame, duration: str, event: str, score: str) -> DataFrame:
    """Concordance counts for survival (K6), usual survival conventions: a pair is
    comparable when the shorter duration is an event; equal durations are
    comparable only when the other one is censored (it outlives); higher score =
    longer predicted survival; equal scores count one half.

    Exact and distributed; the method is described in ``operators.concordance``.
    """
    from lapse.operators.concordance import concordance_counts
    return concordance_counts(df, duration, event, score)
