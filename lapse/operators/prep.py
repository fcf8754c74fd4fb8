"""Leak-free dataset preparation (I1-I8): fit on train, apply everywhere.

Fitted state is always a small DataFrame (medians, encoder mappings,
scaler moments) applied by scalar subquery or join; nothing row-level goes
through the driver.  Randomness is an md5 hash of (seed, key), so splits are
reproducible in any engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapse.operators.metrics import hash_order, hash_uniform
from lapse.operators.ranking import SMALL_ROWS, join_small, row_rank, wide_quantiles
from lapse.session import materialize

SPLITS = ("train", "val", "test")


def stratified_split(df: DataFrame, key: str, stratum: str, fracs=(0.70, 0.15, 0.15), seed: int = 42,
                     exact: bool = True) -> DataFrame:
    """Seeded stratified split.

    exact: inside each stratum rows are ordered by md5(seed:key); the first
    floor(n * f_train) go to train, up to floor(n * (f_train + f_val)) to val,
    the rest to test.  Positions come from the distributed ``row_rank`` (the
    largest stratum is split across tasks).  Otherwise a stateless threshold
    on the hash."""
    f0, f1 = fracs[0], fracs[0] + fracs[1]
    if not exact:
        u = hash_uniform(key, f"split:{seed}")
        return df.withColumn("split", F.when(u < f0, "train").when(u < f1, "val").otherwise("test"))
    d = df.withColumn("_h", hash_order(key, seed))
    r = row_rank(d, ["_h", key], "_pos", partition_cols=[stratum])
    r = join_small(r, d.groupBy(stratum).agg(F.count(F.lit(1)).alias("_ns")), [stratum])
    s = (F.when(F.col("_pos") <= F.floor(F.col("_ns") * f0), "train")
         .when(F.col("_pos") <= F.floor(F.col("_ns") * f1), "val").otherwise("test"))
    return r.withColumn("split", s).drop("_h", "_pos", "_ns")


def stratified_sample(df: DataFrame, key: str, stratum: str, fracs: dict, seed: int = 42,
                      default: float | None = None) -> DataFrame:
    """Seeded per-stratum Bernoulli sample by hash threshold (I2).  The hash is salted by the operator's
    name, so a sample is independent of a split with the same seed.

    ``fracs`` may list None for the NULL stratum.  A stratum that is not listed is sampled at
    ``default``; without one, a row of such a stratum fails the query."""
    f = F.lit(None).cast("double") if default is None else F.lit(float(default))
    for k, v in fracs.items():
        f = F.when(F.col(stratum).eqNullSafe(F.lit(k)), F.lit(float(v))).otherwise(f)
    if default is None:
        lost = F.concat(F.lit(f"stratified_sample: no fraction for {stratum} = "),
                        F.coalesce(F.col(stratum).cast("string"), F.lit("NULL")))
        f = F.coalesce(f, F.raise_error(lost).cast("double"))
    return df.filter(hash_uniform(key, f"sample:{seed}") < f)


def fit_medians(train: DataFrame, cols) -> DataFrame:
    """Exact train medians per column: (column, median)."""
    return wide_quantiles(train, cols, [0.5]).select("column", F.col("q").alias("median"))


def fit_sentinels(train: DataFrame, cols, plus: float = 30) -> DataFrame:
    """'Never happened' sentinel = train max + plus: (column, sentinel) (I4)."""
    wide = train.agg(*[(F.max(F.col(c).cast("double")) + plus).alias(c) for c in cols])
    return wide.unpivot([], list(cols), "column", "sentinel")


def fitted_values(fitted: DataFrame, value_col: str) -> dict:
    """The fitted statistics (one row per column, a few dozen numbers) as a dict."""
    return {r["column"]: r[value_col] for r in fitted.select("column", value_col).collect()}


def apply_fill(df: DataFrame, fitted: DataFrame, value_col: str, cols) -> DataFrame:
    """coalesce(col, fitted value); the fitted values enter the plan as literals."""
    vals = fitted_values(fitted, value_col)
    out = df
    for c in cols:
        v = vals.get(c)
        out = out.withColumn(c, F.coalesce(F.col(c).cast("double"),
                                           F.lit(None if v is None else float(v)).cast("double")))
    return out


def fit_encoders(train: DataFrame, cols) -> dict[str, DataFrame]:
    """Label encoders (I5): per column a table (value, index) of the sorted distinct train categories,
    in the column's own type and order, numbered from 0; NULL is no category."""
    out = {}
    for c in cols:
        d = train.select(F.col(c).alias("value")).filter(F.col("value").isNotNull()).distinct()
        out[c] = materialize(row_rank(d, ["value"], "_idx").select("value", (F.col("_idx") - 1).alias("index")))
    return out


def apply_encoders(df: DataFrame, mappings: dict[str, DataFrame], cols, suffix: str = "_enc") -> DataFrame:
    """Index per category; unseen and NULL -> k (the reserved unknown index).  The mapping is
    counted for k, which also decides whether it can be broadcast."""
    out = df
    for c in cols:
        m = mappings[c]
        k = m.count()
        name = f"{c}{suffix}"
        m = m.select(F.col("value").alias("_value"), F.col("index").alias("_index"))
        out = out.join(F.broadcast(m) if k <= SMALL_ROWS else m, F.col(c) == F.col("_value"), "left") \
            .withColumn(name, F.coalesce(F.col("_index"), F.lit(k)).cast("bigint")).drop("_value", "_index")
    return out


def fit_scaler(train: DataFrame, cols) -> DataFrame:
    """Train mean and population std per column: (column, mean, std) (I6).  One wide aggregate."""
    wide = train.agg(*[F.struct(F.avg(F.col(c).cast("double")).alias("mean"),
                                F.stddev_pop(F.col(c).cast("double")).alias("std")).alias(c) for c in cols])
    return wide.unpivot([], list(cols), "column", "m").select("column", "m.mean", "m.std")


def apply_scaler(df: DataFrame, scaler: DataFrame, cols, suffix: str = "_scaled") -> DataFrame:
    """(x - mean) / std, with std 0 treated as 1 (as a standard scaler does)."""
    means, stds = fitted_values(scaler, "mean"), fitted_values(scaler, "std")
    out = df
    for c in cols:
        std = stds[c] if stds[c] else 1.0
        out = out.withColumn(f"{c}{suffix}", (F.col(c).cast("double") - F.lit(float(means[c]))) / F.lit(float(std)))
    return out


def kfold(df: DataFrame, key: str, k: int = 2, seed: int = 42) -> DataFrame:
    """Seeded fold assignment from the hash (I8)."""
    h = F.conv(F.substring(hash_order(key, seed), 1, 8), 16, 10).cast("bigint")
    return df.withColumn("fold", F.pmod(h, F.lit(k)).cast("bigint"))
