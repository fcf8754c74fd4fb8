"""Plan checks: pushdown / pruning reach the Parquet scan, global ranks do not
plan a single-partition window over row-level data."""
import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from lapse.operators import population as pop
from lapse.operators import ranking as rk
from lapse.sources.schemas import TRANSACTIONS


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_paid_filter_and_pruning_reach_the_scan(spark):
    d = tempfile.mkdtemp(prefix="lapse-plan-")
    rows = [("u", 1, 30, 149, 149, 1, 20161101, 20161201, 0), ("u", 1, 30, 0, 0, 1, 20161201, 20170101, 0)]
    p = os.path.join(d, "txn.parquet")
    spark.createDataFrame(rows, TRANSACTIONS).write.parquet(p)
    refs = pop.ref_dates(pop.with_txn_dates(spark.read.parquet(p)), dt.date(2016, 12, 31))
    plan = _plan(refs)
    pushed = plan.split("PushedFilters: [", 1)[1].split("]", 1)[0]
    assert "GreaterThan(actual_amount_paid,0)" in pushed and "IsNotNull(actual_amount_paid)" in pushed
    # only the four columns the operator needs are read
    assert "ReadSchema: struct<msno:string,actual_amount_paid:int,transaction_date:int,membership_expire_date:int>" in plan
    assert refs.count() == 1


def test_log_window_reaches_the_scan_and_the_folders(spark):
    """On the raw log (int dates, month folders) the window's bounds are pushed as literals."""
    from lapse.functions.dates import ymd
    from lapse.operators.features import log_features
    from lapse.params import REFERENCE_PARAMS
    from lapse.sources.schemas import USER_LOGS
    d = tempfile.mkdtemp(prefix="lapse-plan-")
    rows = [("u", day, 1, 0, 0, 0, 1, 1, 10.0) for day in (20161001, 20161115, 20161201, 20170105)]
    p = os.path.join(d, "logs.parquet")
    spark.createDataFrame(rows, USER_LOGS).withColumn("month", F.expr("date div 100").cast("int")).write.partitionBy("month").parquet(p)
    logs = spark.read.parquet(p).withColumn("log_dt", ymd("date"))
    refs = spark.createDataFrame([("u", dt.date(2016, 12, 1))], "msno string, ref_date date")
    got = log_features(logs, refs, REFERENCE_PARAMS, unbounded_lookback=False)
    plan = _plan(got)
    pushed = plan.split("PushedFilters: [", 1)[1].split("]", 1)[0]
    assert "LessThanOrEqual(date,20161201)" in pushed and "GreaterThanOrEqual(date,20161102)" in pushed
    folders = plan.split("PartitionFilters: [", 1)[1].split("], PushedFilters", 1)[0]
    assert "<= 201612" in folders and ">= 201611" in folders
    assert got.first()["daily_active_days"] == 2


def test_transaction_pass_builds_no_sets(spark):
    from lapse.operators.features import txn_features
    from lapse.params import TEST_PARAMS
    rows = [("u", i, dt.date(2001, 1, i + 1), m, 30, 100, 1, 0, 100) for i, m in enumerate((-128, 0, 63, 64, 127, 127, None))]
    txn = spark.createDataFrame(rows, "msno string, txn_id long, txn_dt date, payment_method_id int, payment_plan_days int, "
                                      "actual_amount_paid int, is_auto_renew int, is_cancel int, plan_list_price int")
    refs = spark.createDataFrame([("u", dt.date(2001, 2, 1))], "msno string, ref_date date")
    got = txn_features(txn, refs, TEST_PARAMS)
    assert "ObjectHashAggregate" not in _plan(got) and got.first()["num_distinct_payment_methods"] == 5


def test_global_rank_has_no_single_partition_window(spark):
    df = spark.range(5000).withColumn("v", (F.col("id") * 7919) % 101)
    plan = _plan(rk.row_rank(df, ["v desc", "id"]))
    for line in plan.splitlines():
        if line.strip().startswith("+- Window") or line.strip().startswith("Window"):
            assert "[_pid" in line, line      # every window over rows is partitioned by the bucket


def test_fused_feature_pass_scans_each_table_once(spark):
    """txn_features: one scan of the transaction source for every aggregate."""
    import __spark_entry__  # noqa: F401  (path setup)
    from lapse.operators.features import txn_features
    from lapse.params import TEST_PARAMS
    from lapse.sources import adapters
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        return
    txn = adapters.transactions(spark.read.parquet(f"{sf}/orders.parquet"))
    refs = pop.ref_dates(txn, TEST_PARAMS.cutoff)
    plan = _plan(txn_features(txn, refs, TEST_PARAMS))
    assert plan.count("FileScan parquet") <= 2   # refs' scan + the feature scan


def test_bucketed_inputs_join_without_shuffle(spark):
    from lapse.sources.io import write_bucketed
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        a = write_bucketed(spark.range(2000).select((F.col("id") % 300).alias("msno"), F.col("id").alias("v")),
                           "lapse_test_txn_b", "msno", 8)
        b = write_bucketed(spark.range(300).select(F.col("id").alias("msno"), (F.col("id") * 2).alias("w")),
                           "lapse_test_refs_b", "msno", 8)
        j = a.join(b, "msno").groupBy("msno").agg(F.sum("v").alias("s"))
        plan = _plan(j)
        assert "Exchange" not in plan, plan
        assert j.count() == 300
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.sql("DROP TABLE IF EXISTS lapse_test_txn_b")
        spark.sql("DROP TABLE IF EXISTS lapse_test_refs_b")


def test_log_pruning_keeps_results(spark):
    """Pruning the log table to the refs' date range changes no feature."""
    from lapse.operators import features as fe
    from lapse.params import TEST_PARAMS as P
    from lapse.sources import adapters
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        return
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    txn = adapters.transactions(orders)
    logs = adapters.user_logs(spark.read.parquet(f"{sf}/lineitem.parquet"), orders)
    refs = pop.ref_dates(txn, P.cutoff)
    a = fe.log_features(logs, refs, P, prune=True).collect()
    b = fe.log_features(logs, refs, P, prune=False).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    w = fe.log_features(logs, refs, P, unbounded_lookback=False).drop("last_login_dt")
    u = fe.log_features(logs, refs, P, prune=False).drop("last_login_dt")
    key = lambda df: sorted(map(tuple, df.filter(F.col("daily_active_days") > 0).collect()))
    assert key(w) == key(u)
