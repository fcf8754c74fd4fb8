"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lapse.session import apply_conf, scratch_path

#: A word is a maximal run of bytes other than space and \t..\r (fixed value of the contracts).
WORD = r"[^\x20\x09-\x0D]+"

#: Spark's setting for deleting an execution's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Rows up to which a side is broadcast after it has been counted; beyond it the
#: join is dealt out by salted keys instead.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    apply_conf(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders of the tables staged inside each open ``discarding``.
_inside: list[list[str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def discarding(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables staged inside are deleted when it ends; the function it gives stages one that stays.
    What is returned from inside must build on such tables (or the inputs) alone."""
    _inside.append([])
    kept = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = stage(df, name)
        kept.append(_inside[-1].pop())
        return out

    try:
        yield keep
    finally:
        for path in _inside.pop():
            _delete(spark, path)
        if _inside:
            _inside[-1].extend(kept)


def discard(df: DataFrame) -> None:
    """Delete a staged table now; nothing may read it later."""
    _delete(df.sparkSession, df._staged)
    for paths in _inside:
        if df._staged in paths:
            paths.remove(df._staged)


#: Spark's setting for the rows of an Arrow batch.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows in what runs inside; a setting that asks for fewer stays."""
    before = spark.conf.get(BATCH)
    if not 0 < int(before) <= rows:
        spark.conf.set(BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    The table has one lineage-free copy that every executor can read, so a lost
    executor costs one reread.  The shuffle files of the write go when it has
    ended, the folder when the application ends (see also ``discarding``).
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}")
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    if _inside:
        _inside[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def numbered(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` as one struct ``_row`` per row and the columns that name a row.  A plain scan of Parquet files names its rows itself,
    by file and row number, so nothing is copied; anything else is written once with a number for each row."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    names = ["_file", "_nth"]
    if docs._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation":
        try:
            return docs.select(row, F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_nth")), names
        except AnalysisException:            # a format without row numbers
            pass
    return stage(docs.select(row, F.lit(0).cast("long").alias("_file"), F.monotonically_increasing_id().alias("_nth")), "numbered"), names


def bounded_join(big: DataFrame, small: DataFrame, on: list[str], rows: int, how: str = "inner",
                 salts: int = 32) -> DataFrame:
    """Join ``big`` to ``small`` on ``on``; ``rows`` is the counted size of ``small``.

    Up to BROADCAST_ROWS the small side is broadcast.  Beyond, each key of the
    small side is repeated ``salts`` times and the big side picks a salt by row,
    so that a key with a third of all rows is spread over ``salts`` tasks.
    """
    if rows <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), on, how)
    s = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    b = big.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    return b.join(s, [*on, "_salt"], how).drop("_salt")


def shuffle_key(*cols: Column | str, seed: int = 0) -> Column:
    """60-bit pseudo-random long of the columns (md5, so that any SQL engine can repeat it)."""
    parts = [F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("null"))
             for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, 15), 16, 10).cast("long")


def bucket_count(rows: int) -> int:
    """Buckets for two-level prefix sums: about sqrt(rows) buckets of about sqrt(rows) rows."""
    return max(16, math.isqrt(max(rows, 0)) + 1)


def running(df: DataFrame, group: list[str], key: str, ties: list[str], amounts: dict[str, Column],
            buckets: int, totals: dict[str, str] | None = None) -> DataFrame:
    """Exclusive prefix sums of ``amounts`` (output name -> value) within each group in the order
    (key, ties).  ``key`` is a 60-bit long as of ``shuffle_key``.

    Two levels, so that no group has to fit one task: rows are summed within
    (group, bucket of the key); a table with one row per (group, bucket) gets
    the bucket offsets.  Group columns must not be null.  ``totals`` adds the
    group's total of an amount (output name -> amount name).
    """
    totals = totals or {}
    width = -(-(1 << 60) // buckets)
    d = df.withColumn("_b", F.expr(f"`{key}` div {width}L"))
    for name, value in amounts.items():
        d = d.withColumn(f"_a_{name}", value.cast("long"))
    per = d.groupBy(*group, "_b").agg(*[F.sum(f"_a_{n}").alias(f"_s_{n}") for n in amounts])
    before = W.partitionBy(*group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*group)
    offs = per.select(*group, "_b",
                      *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in amounts],
                      *[F.sum(f"_s_{a}").over(whole).alias(t) for t, a in totals.items()])
    inner = W.partitionBy(*group, "_b").orderBy(key, *ties).rowsBetween(W.unboundedPreceding, -1)
    local = d.select("*", *[F.coalesce(F.sum(f"_a_{n}").over(inner), F.lit(0)).alias(f"_l_{n}") for n in amounts])
    out = local.join(offs, [*group, "_b"])
    return out.select(*df.columns, *[(F.col(f"_o_{n}") + F.col(f"_l_{n}")).alias(n) for n in amounts], *totals)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of the edges (a, b) of longs: id, component (smallest id), for every id of an edge.

    Alternating large-star and small-star rounds; after each pair of rounds the
    edges are written, until they are stars.  Every round is joins and minima over
    edges, so no component is ever in one place.
    """
    e = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stage(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), name)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(0xFFFFFFFF))).first())
        if now == state or not now[0]:
            break
        state = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
