"""Addresses of pages that arrive as files: Structured Streaming over a folder, first found wins, restartable."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from kontor.functions.email import with_emails
from kontor.functions.url import host_of, registrable, site_from_url
from kontor.plans.collect import email_columns
from kontor.policy import DEFAULT, ContactPolicy

KEYS = ["email", "site_key"]


def found_emails(pages: DataFrame, policy: ContactPolicy = DEFAULT) -> DataFrame:
    """Addresses of pages (page_id, url, html), as rows of the table of addresses."""
    rows = pages.select(F.col("page_id").alias("seq"), "url", site_from_url(F.col("url"), policy)["site_key"].alias("site_key"), "html")
    rows = with_emails(rows, policy=policy).select("seq", "url", "site_key", F.explode("emails").alias("email"))
    own = F.array(registrable(host_of(F.col("url")), policy))
    return rows.where("site_key IS NOT NULL").select(*email_columns("email", F.col("site_key"), F.lit(0), own, F.col("url"), F.col("seq"), policy))


def read_state(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """What the batches before have appended; empty before the first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(StructType(schema.fields)).parquet(folder) if there else spark.createDataFrame([], schema)


def append_new(folder: str, policy: ContactPolicy = DEFAULT):
    """For foreachBatch: appends a batch's new addresses. Each batch has its own part, so that a batch that runs again replaces itself."""
    from kontor.operators.state import add_new

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = found_emails(batch, policy)
        schema = StructType([*rows.schema.fields, StructField("batch", IntegerType())])
        before = read_state(spark, folder, schema).where(F.col("batch") != number)
        new = add_new(before, rows, KEYS, "ingest_seq", "source_url")
        new.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return each


def stream(spark: SparkSession, source: str, schema: StructType, state: str, checkpoint: str, policy: ContactPolicy = DEFAULT, files_at_once: int = 100) -> StreamingQuery:
    """Reads the files of a folder that were not read yet, and ends. A query started again goes on where the last one was."""
    pages = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(source)
    return pages.writeStream.foreachBatch(append_new(state, policy)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events of each type by time, also of a stream: late rows count as long as the watermark allows."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
