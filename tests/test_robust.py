"""Rows that must not get lost: large and textual ids, NULL groups, NULL and infinite scores, repeated days."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from lapse.operators import features as fe
from lapse.operators import metrics as met
from lapse.operators import prep
from lapse.operators import ranking as rk


@pytest.mark.parametrize("kind,small,large", [("long", 1, 2 ** 40 + 5), ("long", -7, 2 ** 62), ("string", "a", "b9")])
def test_latest_row_by_date_then_id(spark, kind, small, large):
    d1, d2 = dt.date(2020, 1, 1), dt.date(2020, 1, 2)
    rows = [("u", d1, large, 1), ("u", d2, small, 2), ("v", d1, small, 3), ("v", d1, large, 4), ("w", None, small, 5)]
    df = spark.createDataFrame(rows, f"k string, d date, id {kind}, x int")
    got = {r["k"]: r["x"] for r in fe.latest_per(df, "k", ["d", "id"], ["x"]).collect()}
    assert got == {"u": 2, "v": 4, "w": 5}
    some = fe.latest_per(df, "k", ["d", "id"], ["x"], where=F.col("x") < 4).collect()
    assert {r["k"]: r["x"] for r in some} == {"u": 2, "v": 3}


def test_null_groups_keep_their_rows(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else i % 2, float(i % 7)) for i in range(1000)], "msno long, g int, v double")
    s = prep.stratified_split(df, "msno", "g")
    assert s.count() == 1000 and s.where("g is null and split = 'train'").count() == 140
    q = {r["g"]: r["q"] for r in rk.quantiles(df, "v", [0.5], by=["g"]).collect()}
    assert set(q) == {None, 0, 1}
    a = rk.avg_rank(df, "v", by=["g"])
    assert a.count() == 1000 and a.where("rank_avg is null").count() == 0
    r = rk.row_rank(df, ["v", "msno"], "r", partition_cols=["g"])
    assert {x["g"]: (x["n"], x["m"]) for x in r.groupBy("g").agg(F.count("r").alias("n"), F.max("r").alias("m")).collect()} == {
        None: (200, 200), 0: (400, 400), 1: (400, 400)}


def test_sample_of_unlisted_strata(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else i % 2) for i in range(100)], "msno long, g int")
    assert prep.stratified_sample(df, "msno", "g", {0: 1.0, 1: 1.0, None: 1.0}).count() == 100
    assert prep.stratified_sample(df, "msno", "g", {0: 1.0}, default=0.0).count() == 40
    with pytest.raises(Exception, match="no fraction for g"):
        prep.stratified_sample(df, "msno", "g", {0: 1.0, 1: 1.0}).count()


def test_sample_is_independent_of_the_split(spark):
    df = spark.range(2000).select(F.col("id").alias("msno"), F.lit(1).alias("y"))
    split = prep.stratified_split(df, "msno", "y")
    sample = prep.stratified_sample(split, "msno", "y", {1: 0.3})
    n = {r["split"]: r["count"] for r in sample.groupBy("split").count().collect()}
    assert n.get("val", 0) > 30 and n.get("test", 0) > 30


def test_curves_over_scored_rows_only(spark):
    df = spark.createDataFrame([(0.9, 1), (0.4, 0), (None, 1), (None, 0), (0.2, 1)], "s double, y int")
    roc = met.roc_curve(df, "s", "y").agg(F.max("tpr"), F.max("fpr")).first()
    assert tuple(roc) == (1.0, 1.0)
    pr = met.pr_curve(df, "s", "y").agg(F.max("recall"), F.first("base_rate")).first()
    assert pr[0] == 1.0 and pr[1] == pytest.approx(2 / 3)


@pytest.mark.parametrize("bad", [None, float("nan"), float("inf")])
def test_metrics_never_cover_a_part(spark, bad):
    df = spark.createDataFrame([(1.0, 2.0), (bad, 1.0)], "p double, y double")
    r = met.regression_metrics(df, "p", "y").first()
    assert (r["n"], r["n_nonfinite"], r["rmse"], r["mae"], r["r2"]) == (2, 1, None, None, None)
    with pytest.raises(Exception, match="p is not finite"):
        met.require_finite(df, "p").agg(F.sum("p")).collect()


def test_repeated_days_count_once(spark):
    from lapse.params import TEST_PARAMS as P
    ref = dt.date(2000, 6, 30)
    logs = spark.createDataFrame([("u", ref, 1, 1, 1, 1, 1, 2, 10.0), ("u", ref, 1, 1, 1, 1, 1, 3, 20.0),
                                  ("u", ref - dt.timedelta(days=100), 1, 0, 0, 0, 0, 1, 5.0)],
                                 "msno string, log_dt date, num_25 int, num_50 int, num_75 int, num_985 int, num_100 int, num_unq int, total_secs double")
    refs = spark.createDataFrame([("u", ref)], "msno string, ref_date date")
    r = fe.log_features(logs, refs, P, with_candidates=True).first()
    assert (r["daily_active_days"], r["recent_daily_active_days"], r["sum_unq"], r["sum25"]) == (2, 1, 6, 3)
    assert r["std_dev_daily_secs"] == pytest.approx(7.637626158)


def test_cumulative_builds_fast_at_many_partitions(spark):
    import time
    df = spark.range(5000).withColumn("v", (F.col("id") * 7919) % 101)
    t = time.time()
    got = rk.cumulative(df, ["v", "id"], ["v"], n_parts=200)
    assert time.time() - t < 60
    want, total = {}, 0
    for n, (v, i) in enumerate(sorted((i * 7919 % 101, i) for i in range(5000)), 1):
        total += v
        want[i] = (n, total)
    assert {r["id"]: (r["_row"], r["cum_v"]) for r in got.collect()} == want


def test_small_sides_do_not_move_the_big_one(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        big = spark.range(1000).withColumn("g", F.col("id") % 3)
        j = rk.join_small(big, big.groupBy("g").agg(F.count("*").alias("n")), ["g"])
        assert "BroadcastHashJoin" in j._jdf.queryExecution().executedPlan().toString()
        enc = prep.apply_encoders(big, prep.fit_encoders(big, ["g"]), ["g"])
        assert "hashpartitioning(g" not in enc._jdf.queryExecution().executedPlan().toString()
        assert enc.where("g_enc = g").count() == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_metrics_count_the_rows_they_leave_out(spark):
    from lapse.operators.concordance import concordance_counts
    df = spark.createDataFrame([(0.9, 1, 5), (None, 1, 4), (0.2, 0, 3), (None, 0, None), (0.4, 1, None)], "s double, y int, d int")
    assert met.auc_roc(df, "s", "y").first().n_left_out == 2 and met.average_precision(df, "s", "y").first().n_left_out == 2
    assert concordance_counts(df, "d", "y", "s").first().n_left_out == 3


def test_wide_quantiles_are_exact(spark):
    import numpy as np
    r = np.random.default_rng(4)
    n = 3000
    cols = {"a": r.normal(size=n), "b": r.integers(0, 3, n).astype(float), "c": np.round(r.exponential(size=n), 1), "d": np.full(n, 7.0)}
    rows = [tuple(float(v[i]) if (i + j) % 11 else None for j, v in enumerate(cols.values())) for i in range(n)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").withColumn("e", F.lit(None).cast("double")).repartition(5)
    for accuracy in (100, 10_000):         # brackets, and whole columns
        got = {(x["column"], x["p"]): x["q"] for x in rk.wide_quantiles(df, [*cols, "e"], [0.0, 0.01, 0.25, 0.5, 0.9, 1.0], accuracy).collect()}
        for j, c in enumerate(cols):
            v = np.array([x[j] for x in rows if x[j] is not None])
            for p in (0.0, 0.01, 0.25, 0.5, 0.9, 1.0):
                assert got[c, p] == pytest.approx(np.quantile(v, p)), (c, p, accuracy)
        assert got["e", 0.5] is None
