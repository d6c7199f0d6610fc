"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a temporary folder only where that is unset and all runs in one process (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        made = tempfile.mkdtemp(prefix="kontor-")
        atexit.register(shutil.rmtree, made, True)
        found = f"file://{made}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder. It lives as long as the application, since results are lazy."""
    path = f"{shared_dir(spark)}/kontor-llm/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the JVM may be gone when Python ends
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written as a Parquet table and read again: cuts the lineage, survives lost executors, runs `df` once."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._scratch = path
    return found


def dropped(table: DataFrame) -> None:
    """Deletes what written() made, where nothing reads it any more."""
    _delete(table.sparkSession, table._scratch)


def bucketed(df: DataFrame, name: str, buckets: int, key: str) -> DataFrame:
    """Like `written`, in `buckets` buckets by `key`: a later join or group by that key reads it in place."""
    spark = df.sparkSession
    table = f"kontor_{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(buckets, key).option("path", new_path(spark, name)).saveAsTable(table)
    atexit.register(_forget, spark, table)
    return spark.table(table)


#: Rows of texts that are sent to Python at once, where the session does not say otherwise.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches from Spark's default to BATCH_ROWS rows, for operators that send texts to Python.

    A batch is held by Spark and by Python at once, and grows by doubling; batches are read when a plan runs, so the
    setting stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def _forget(spark: SparkSession, table: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    except Exception:
        pass
