"""Scans and sinks.

Everything is a distributed read or write; file splits replace the reference's
bounded-memory chunking, and ``mode("ignore")`` replaces its skip-if-exists
checks.
"""

from __future__ import annotations

import json
import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations")


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Parquet scan by path (vectorised reader; pruning and pushdown by Catalyst)."""
    return spark.read.parquet(os.path.join(directory, f"{name}.parquet"))


def read_csv(spark: SparkSession, path: str, schema: StructType, header: bool = True) -> DataFrame:
    """Typed CSV scan with a declared schema (no inference pass over the data)."""
    return (spark.read.schema(schema).option("header", header).option("mode", "FAILFAST")
            .csv(path))


def write_once(df: DataFrame, path: str, fmt: str = "parquet", **opts) -> str:
    """Idempotent materialisation: an existing output is left untouched."""
    w = df.write.mode("ignore").format(fmt)
    for k, v in opts.items():
        w = w.option(k, v)
    w.save(path)
    return path


def csv_to_parquet(spark: SparkSession, src: str, dst: str, schema: StructType,
                   partition_by: list[str] | None = None) -> str:
    """Large CSV -> zstd Parquet.  Input splits bound memory per task."""
    df = read_csv(spark, src, schema)
    w = df.write.mode("ignore").option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(dst)
    return dst


def table_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """Row and column counts per table, as one small DataFrame."""
    parts = [df.agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"))
             .select(F.lit(name).alias("table_name"), "n_rows",
                     F.lit(len(df.columns)).cast("bigint").alias("n_columns"))
             for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def write_splits(df: DataFrame, out_dir: str, split_col: str = "split",
                 names=("train", "val", "test")) -> dict[str, str]:
    """All splits in one write (A7): a folder per value of ``split_col``.  Returns the folder of each of ``names``."""
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(split_col).parquet(out_dir)
    return {n: f"{out_dir.rstrip('/')}/{split_col}={n}" for n in names}


def load_splits(spark: SparkSession, out_dir: str, names=("train", "val", "test"), split_col: str = "split") -> dict[str, DataFrame]:
    """Load a chosen subset of splits (A9); only their folders are read."""
    whole = spark.read.parquet(out_dir)
    return {n: whole.filter(F.col(split_col) == n).drop(split_col) for n in names}


def write_scores(df: DataFrame, path: str) -> str:
    """CSV sink of scores with a header line."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_json(obj_or_df, path: str, spark: SparkSession | None = None) -> str:
    """JSON sink of a metrics / manifest / decision record.

    A DataFrame is written distributed; a small dict (fitted parameters, a few
    scalars) is written as one JSON document."""
    if isinstance(obj_or_df, DataFrame):
        obj_or_df.write.mode("overwrite").json(path)
        return path
    if "://" in path and spark is not None:
        spark.createDataFrame([(json.dumps(obj_or_df, default=str),)], "value string") \
            .coalesce(1).write.mode("overwrite").text(path)
        return path
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w") as fh:
        json.dump(obj_or_df, fh, indent=2, default=str)
    return path


def write_bucketed(df: DataFrame, table_name: str, key: str, n_buckets: int, sort: bool = True,
                   mode: str = "overwrite") -> DataFrame:
    """Persist a table bucketed (and sorted) on the user key.

    The layout for the large inputs at scale: transactions and usage logs
    written with the same bucket count on ``msno`` make every per-user join
    and aggregation of the feature build shuffle-free (the reference dates,
    aggregated from bucketed transactions, keep that partitioning)."""
    w = df.write.mode(mode).format("parquet").bucketBy(n_buckets, key)
    if sort:
        w = w.sortBy(key)
    w.saveAsTable(table_name)
    return df.sparkSession.table(table_name)
