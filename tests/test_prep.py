import numpy as np
from pyspark.sql import functions as F

from lapse.operators import prep


def test_encoder_reserved_unknown(spark):
    tr = spark.createDataFrame([(v,) for v in "abcab"], "c string")
    m = {r["value"]: r["index"] for r in prep.fit_encoders(tr, ["c"])["c"].collect()}
    assert m == {"a": 0, "b": 1, "c": 2}


def test_encoder_unseen_and_missing(spark):
    tr = spark.createDataFrame([("a",), ("b",)], "c string")
    ap = spark.createDataFrame([(0, "a"), (1, "b"), (2, "z"), (3, "z"), (4, None)], "i int, c string")
    out = prep.apply_encoders(ap, prep.fit_encoders(tr, ["c"]), ["c"]).orderBy("i")
    assert [r.c_enc for r in out.collect()] == [0, 1, 2, 2, 2]
    assert dict(out.dtypes)["c_enc"] == "bigint"


def test_encoder_null_not_a_class(spark):
    tr = spark.createDataFrame([("a",), (None,), ("b",)], "c string")
    assert prep.fit_encoders(tr, ["c"])["c"].count() == 2


def test_encoder_numeric_order(spark):
    tr = spark.createDataFrame([(2,), (10,), (1,)], "c int")
    m = {r["value"]: r["index"] for r in prep.fit_encoders(tr, ["c"])["c"].collect()}
    assert m[10] == 2      # numeric, not string, order


def test_scaler_population_std_and_no_refit(spark):
    rng = np.random.default_rng(0)
    tr = spark.createDataFrame([(float(x),) for x in rng.normal(10, 5, 1000)], "x double")
    sc = prep.fit_scaler(tr, ["x"])
    a = prep.apply_scaler(tr, sc, ["x"]).agg(F.avg("x_scaled"), F.stddev_pop("x_scaled")).first()
    assert abs(a[0]) < 1e-9 and abs(a[1] - 1) < 1e-9
    shifted = spark.createDataFrame([(float(x),) for x in rng.normal(50, 5, 1000)], "x double")
    m = prep.apply_scaler(shifted, sc, ["x"]).agg(F.avg("x_scaled")).first()[0]
    assert abs(m) > 1
    once = prep.apply_scaler(shifted, sc, ["x"]).select("x_scaled").collect()
    twice = prep.apply_scaler(shifted, sc, ["x"]).select("x_scaled").collect()
    assert once == twice


def test_stratified_split_exact_counts(spark):
    df = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(1000)], "msno long, y int")
    s = prep.stratified_split(df, "msno", "y", (0.7, 0.15, 0.15), 42)
    c = {(r.y, r.split): r["count"] for r in s.groupBy("y", "split").count().collect()}
    assert c[(0, "train")] == 525 and c[(1, "train")] == 175
    assert s.count() == 1000 and s.select("msno").distinct().count() == 1000
