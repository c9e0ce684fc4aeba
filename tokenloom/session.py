"""Session helpers.

The cluster owns ``spark.checkpoint.dir``, a folder that the driver and all
executors share; we only read it.  A local[..] session (tests) that starts without
one gets a private folder; anywhere else an unset folder is an error.
"""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "tokenloom") -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # token arrays are several times the compressed text: smaller input splits
        .config("spark.sql.files.maxPartitionBytes", os.environ.get("TOKENLOOM_MAX_PARTITION_BYTES", "32m"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    # fixed before the session starts: a running session refuses to change it
    if SparkSession.getActiveSession() is None and not _configured("spark.checkpoint.dir") and re.match(r"local(\[|$)", master or f"local[{cpus}]"):
        builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tokenloom-ckpt-"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; a local[..] session may make its own."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = _LOCAL.setdefault(spark.sparkContext.applicationId, None) or tempfile.mkdtemp(prefix="tokenloom-ckpt-")
        _LOCAL[spark.sparkContext.applicationId] = d
    try:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(d)
    except Exception:  # sessions without a SparkContext handle
        pass
    return d


#: Folders of local sessions that were started by others without one; their setting can't be changed any more.
_LOCAL: dict[str, str | None] = {}


def _configured(key: str) -> bool:
    """Whether Spark's own configuration (its files, and what was submitted) sets a key."""
    from pyspark import SparkConf, SparkContext
    SparkContext._ensure_initialized()
    return bool(SparkConf().get(key, None))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, unless PYTHONPATH already names it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if root in [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]:
        return
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        name = os.path.join(tempfile.mkdtemp(prefix="tokenloom-package-"), "tokenloom")  # the driver's file server sends it on
        spark.sparkContext.addPyFile(shutil.make_archive(name, "zip", root, "tokenloom"))
        _SHIPPED.add(app)


_SHIPPED: set[str] = set()


#: Rows and bytes of an Arrow batch: the JVM and Python both hold a batch, and what Python makes of it.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_ROWS`` rows and about ``BATCH_BYTES`` for this session's Python tasks
    (smaller settings stay): whole texts are long, and Spark's own limit counts rows alone."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        n, unit = re.fullmatch(r"(-?\d+)([a-z]?)b?", spark.conf.get(key).strip().lower()).groups()
        if not 0 < int(n) << {"k": 10, "m": 20, "g": 30}.get(unit, 0) <= most:
            spark.conf.set(key, str(most))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"
