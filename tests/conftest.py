import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from lapse.session import get_spark
    s = get_spark("local[4]", app="lapse-tests", shuffle_partitions=4,
                  extra={"spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    if not s.conf.get("spark.checkpoint.dir", None):
        s.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="lapse-test-ckpt-"))
    yield s


# Label rules: cut-off 2016-12-31, grace 30 days, forward window 59 days.
CUTOFF_PARAMS = dict(grace=30, fwd=59)


@pytest.fixture(scope="session")
def label_txn(spark):
    """Hand-built transactions (raw schema, int YYYYMMDD dates) covering the
    label edge cases: clean churner, renewal, free trial, corrupted expiry,
    grace boundaries, revenue boundary, beyond cut-off, same-day tie."""
    rows = [
        # msno, pay_method, plan_days, list, paid, auto, txn, expire, cancel
        ("churner", 1, 30, 149, 149, 1, 20161101, 20161201, 0),
        ("renewer", 1, 30, 149, 149, 1, 20161101, 20161201, 0),
        ("renewer", 1, 30, 150, 150, 1, 20161205, 20170105, 0),
        ("trial", 1, 30, 0, 0, 0, 20161101, 20161201, 0),
        ("corrupt", 2, 30, 149, 149, 1, 20161001, 20161101, 0),
        ("corrupt", 2, 30, 149, 149, 0, 20161215, 20161210, 1),
        ("grace30", 1, 30, 149, 149, 1, 20161001, 20161101, 0),
        ("grace30", 1, 30, 149, 149, 1, 20161201, 20170101, 0),
        ("grace31", 1, 30, 149, 149, 1, 20161001, 20161101, 0),
        ("grace31", 1, 30, 149, 149, 1, 20161202, 20170102, 0),
        ("revenue", 1, 30, 149, 149, 1, 20160901, 20161001, 0),
        ("revenue", 1, 30, 200, 200, 1, 20161129, 20170301, 0),
        ("revenue", 1, 30, 300, 300, 1, 20161130, 20170301, 0),
        ("beyond", 1, 30, 149, 149, 1, 20161215, 20170115, 0),
        ("freerenew", 1, 30, 149, 149, 1, 20161001, 20161101, 0),
        ("freerenew", 1, 30, 0, 0, 1, 20161110, 20170110, 0),
        ("sameday", 3, 30, 149, 149, 1, 20161001, 20161101, 0),
        ("sameday", 4, 60, 149, 99, 0, 20161001, 20161201, 1),
    ]
    from lapse.operators.population import with_txn_dates
    from lapse.sources.schemas import TRANSACTIONS
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, TRANSACTIONS)
    df = with_txn_dates(df).withColumn("txn_id", F.monotonically_increasing_id())
    return df.cache()
