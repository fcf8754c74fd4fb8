import os
import tempfile

from pyspark.sql import functions as F

from lapse.sources import io
from lapse.sources.schemas import USER_LOGS

ROWS = [("u1", 20170101, 1, 2, 3, 4, 5, 6, 100.5), ("u2", 20170102, 0, 0, 0, 0, 1, 1, 90000.0)]


def _write_csv(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as fh:
        fh.write("msno,date,num_25,num_50,num_75,num_985,num_100,num_unq,total_secs\n")
        for r in rows:
            fh.write(",".join(str(v) for v in r) + "\n")


def test_typed_csv_scan_and_parquet_write_once(spark):
    d = tempfile.mkdtemp(prefix="lapse-src-")
    _write_csv(os.path.join(d, "csv"), "a.csv", ROWS)
    df = io.read_csv(spark, os.path.join(d, "csv"), USER_LOGS)
    assert df.schema == USER_LOGS and df.count() == 2
    out = io.csv_to_parquet(spark, os.path.join(d, "csv"), os.path.join(d, "pq"), USER_LOGS)
    assert spark.read.parquet(out).count() == 2
    # idempotent: a second write leaves the existing output alone
    io.write_once(spark.range(5).toDF("msno"), out)
    assert spark.read.parquet(out).count() == 2


def test_incremental_ingest_is_exactly_once(spark):
    from lapse.streaming import ingest_incremental
    d = tempfile.mkdtemp(prefix="lapse-stream-")
    src, dst, ck = os.path.join(d, "in"), os.path.join(d, "out"), os.path.join(d, "ckpt")
    _write_csv(src, "part1.csv", ROWS)
    ingest_incremental(spark, src, dst, USER_LOGS, checkpoint=ck, date_col="date")
    assert spark.read.parquet(dst).count() == 2
    _write_csv(src, "part2.csv", [("u3", 20170201, 1, 1, 1, 1, 1, 1, 5.0)])
    ingest_incremental(spark, src, dst, USER_LOGS, checkpoint=ck, date_col="date")
    got = spark.read.parquet(dst)
    assert got.count() == 3 and sorted(r.month for r in got.select("month").distinct().collect()) == [201701, 201702]


def test_table_stats(spark):
    t = io.table_stats({"a": spark.range(3), "b": spark.range(5).withColumn("x", F.lit(1))})
    assert {r.table_name: (r.n_rows, r.n_columns) for r in t.collect()} == {"a": (3, 1), "b": (5, 2)}


def test_write_and_reload_splits_and_json(spark):
    import json
    d = tempfile.mkdtemp(prefix="lapse-splits-")
    df = spark.createDataFrame([(1, "train"), (2, "val"), (3, "test"), (4, "train")], "msno long, split string")
    io.write_splits(df, d)
    got = io.load_splits(spark, d, ("train", "test"))
    assert got["train"].count() == 2 and got["test"].count() == 1 and "split" not in got["train"].columns
    p = io.write_json({"chosen": "hurdle", "rmse": 1.5}, os.path.join(d, "choice.json"))
    assert json.load(open(p))["chosen"] == "hurdle"
    io.write_scores(df, os.path.join(d, "scores.csv"))
    assert spark.read.option("header", True).csv(os.path.join(d, "scores.csv")).count() == 4


def test_manifest_columns_roundtrip():
    from lapse.operators.pipeline import columns_from_manifest
    row = {"categorical": '[{"name":"city","column":"city_enc","cardinality":5,"unknown_index":4}]',
           "numerical_scaled": "a_scaled,b_scaled", "numerical_unscaled": "c"}
    assert columns_from_manifest(row) == ["city_enc", "a_scaled", "b_scaled", "c"]
