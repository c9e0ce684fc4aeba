"""Small shared pieces of the operators: sizes, written tables, scratch folders."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.session import ensure_checkpoint_dir


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names (a local session without one has its own); elsewhere an unset one is an error."""
    return ensure_checkpoint_dir(spark).rstrip("/")


#: Folders that this process has made under the shared one, the oldest first.
MADE: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared one."""
    MADE.append(f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}")
    return MADE[-1]


def clear(spark: SparkSession, paths: list[str]) -> None:
    """Remove folders that nothing reads any more."""
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        MADE.remove(p)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Total UTF-8 bytes of a text column (sizes groups and partitions)."""
    return int(docs.agg(F.sum(F.octet_length(column))).first()[0] or 0)


#: Rows per Arrow batch: whole texts are long, and a batch is held by the JVM and by Python at once.
BATCH_ROWS = 500


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_ROWS`` rows for this session's Python tasks (a smaller setting stays)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
