"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

# Settings every plan in this package assumes.  AQE re-plans joins at run
# time: a shuffled side that turns out small becomes a broadcast (the size
# check), skewed partitions of a sort-merge join are split even when that
# adds a shuffle (the split partitions are then pre-aggregated map-side).
SPARK_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # checkpoint files of unreferenced intermediates are removed (static: takes
    # effect for sessions built by get_spark)
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


#: Spark's setting for deleting an execution's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_spark(master: str | None = None, app: str = "lapse", shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(SPARK_CONF)
    conf["spark.ui.enabled"] = "false"
    conf.setdefault("spark.driver.memory", os.environ.get("LAPSE_DRIVER_MEMORY", "16g"))
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    apply_conf(spark)
    return spark


def apply_conf(spark: SparkSession) -> None:
    """Apply the runtime-settable part of SPARK_CONF to an existing session."""
    for k, v in SPARK_CONF.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # static conf on a shared session: leave as is
            pass


#: Least number of partitions a shuffle is dealt into before AQE joins small neighbours, and the most shuffled bytes AQE joins
#: into one task.  Rows of a log or transaction take some twenty times their shuffled size in an aggregate's hash maps.
SHUFFLE_PARTS, TASK_BYTES = 1000, 16 << 20
ADVISORY, INITIAL = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def _bytes(size: str) -> int:
    size = size.strip().lower().removesuffix("b")
    unit = {"k": 10, "m": 20, "g": 30, "t": 40}.get(size[-1:])
    return int(size[:-1]) << unit if unit else int(size)


def bound_tasks(spark: SparkSession) -> None:
    """Keep the memory of a task from growing with the input: more input makes more tasks, not larger ones.
    Settings that already ask for smaller tasks or more partitions stay."""
    if _bytes(spark.conf.get(ADVISORY, "64m")) > TASK_BYTES:
        spark.conf.set(ADVISORY, str(TASK_BYTES))
    if int(spark.conf.get(INITIAL, None) or spark.conf.get("spark.sql.shuffle.partitions", "200")) < SHUFFLE_PARTS:
        spark.conf.set(INITIAL, str(SHUFFLE_PARTS))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (spark.checkpoint.dir).

    Only when the setting is unset (tests, a laptop) and the master is local do we
    pick a folder of our own; a cluster without the setting is refused, because its
    executors would not see the driver's folder.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # a Spark Connect session: the server's setting applies
        return spark.conf.get("spark.checkpoint.dir", None) or ""
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="lapse-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediate tables."""
    base = checkpoint_dir(spark)
    return os.path.join(base, name) if "://" not in base else base.rstrip("/") + "/" + name


_writing = threading.Lock()
_writers: dict = {"n": 0, "before": "false"}


def _clean_up(spark: SparkSession, begins: bool) -> None:
    """CLEANUP is on while any thread writes an intermediate table and as it was before once the last one has ended."""
    with _writing:
        if begins and not _writers["n"]:
            _writers["before"] = spark.conf.get(CLEANUP, "false")
            spark.conf.set(CLEANUP, "true")
        _writers["n"] += 1 if begins else -1
        if not _writers["n"]:
            spark.conf.set(CLEANUP, _writers["before"])


def together(*calls) -> list:
    """Results of independent calls, whose Spark jobs run side by side."""
    if len(calls) < 2:
        return [c() for c in calls]
    spark = SparkSession.getActiveSession()
    inherit = inheritable_thread_target(spark) if spark else inheritable_thread_target
    with ThreadPool(len(calls)) as pool:
        return pool.map(lambda c: c(), [inherit(c) for c in calls], chunksize=1)


def materialize(df):
    """Write an intermediate table as Parquet into the shared checkpoint folder and read it again.

    Used where one intermediate feeds several consumers (ranked results,
    scored populations, range-partitioned inputs): the consumers read the
    same written data, and only the columns they need; plans stay small; a lost
    executor re-reads the table instead of recomputing a long lineage.  The table
    goes when the application ends.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    path = scratch_path(spark, f"{spark.sparkContext.applicationId}/{uuid.uuid4().hex[:12]}")
    _clean_up(spark, True)                # the write's shuffle files go when it has ended
    try:
        df.write.parquet(path)
    finally:
        _clean_up(spark, False)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)
