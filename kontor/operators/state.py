"""Keyed tables that grow by batches: the first row of a key wins, or the last."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


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


def cut(df: DataFrame) -> DataFrame:
    """`df` computed once and kept as a table in the shared folder, without its lineage, as long as the application lives."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kontor/{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the JVM may be gone when Python ends
        pass


def first_of_each(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """For each key the first row by `order`. Spark drops later rows of a key before it shuffles."""
    return df.withColumn("_turn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_turn = 1").drop("_turn")


def add_new(existing: DataFrame, incoming: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The incoming rows to append: those whose key is complete and not there yet, the first of each key."""
    complete = incoming.dropna(subset=keys)
    return first_of_each(complete.join(existing.select(*keys), keys, "left_anti"), keys, *order).select(*incoming.columns)


def replace_rows(existing: DataFrame, incoming: DataFrame, keys: list[str], order: Column | str = "ingest_seq") -> DataFrame:
    """The whole table after a batch in which the last row of a key replaces what was there."""
    both = existing.withColumn("_batch", F.lit(0)).unionByName(incoming.withColumn("_batch", F.lit(1)))
    order = F.col(order) if isinstance(order, str) else order
    return first_of_each(both.dropna(subset=keys), keys, F.col("_batch").desc(), order.desc()).drop("_batch")


def reset_failed(sites: DataFrame) -> DataFrame:
    """Sites that could not be read become pending again."""
    return sites.withColumn("status", F.when(F.col("status").isin("unreachable", "timeout", "error"), "pending").otherwise(F.col("status")))


def without_email(sites: DataFrame, emails: DataFrame) -> DataFrame:
    """Sites that were read and gave no address."""
    return sites.where("status = 'ok'").join(emails.where("site_key <> ''").select("site_key").distinct(), "site_key", "left_anti")


def reset_without_email(sites: DataFrame, emails: DataFrame) -> DataFrame:
    """Those become pending again."""
    again = without_email(sites, emails).select("site_key", F.lit(True).alias("_again"))
    return sites.join(again, "site_key", "left").withColumn("status", F.when(F.col("_again"), "pending").otherwise(F.col("status"))).select(*sites.columns)


def pending(sites: DataFrame, limit: int | None = None) -> DataFrame:
    """Sites to read, given ones before guessed ones, then by entry."""
    found = sites.where("status = 'pending'").orderBy("guessed", "ingest_seq")
    return found.limit(limit) if limit else found


def network_sites(businesses: DataFrame, least: int = 3) -> DataFrame:
    """(site_key, n) of sites that several businesses share."""
    return businesses.where("site_key IS NOT NULL").groupBy("site_key").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def save_sites(sites: DataFrame, read: DataFrame) -> DataFrame:
    """`sites` with status, final_url and pages of those that were read (site_key, status, final_url, pages)."""
    new = read.select("site_key", *(F.col(c).alias(f"_{c}") for c in ("status", "final_url", "pages")))
    kept = {c: F.when(F.col("_status").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)) for c in ("status", "final_url", "pages")}
    return sites.join(new, "site_key", "left").withColumns(kept).select(*sites.columns)


def link_guessed(businesses: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Businesses without a site get that of their first confirmed guess (business_id, site_key, url)."""
    first = first_of_each(confirmed, ["business_id"], "site_key").select(F.col("business_id").alias("id"), F.col("site_key").alias("_key"), F.col("url").alias("_url"))
    takes = F.col("site_key").isNull() & F.col("_key").isNotNull()
    joined = businesses.join(first, "id", "left")
    return joined.withColumn("website", F.when(takes, F.col("_url")).otherwise(F.col("website"))).withColumn("site_key", F.when(takes, F.col("_key")).otherwise(F.col("site_key"))).select(*businesses.columns)


def suppress(emails: DataFrame, opted_out: DataFrame) -> DataFrame:
    """Addresses without those whose owners objected: (value) is an address or a whole domain."""
    values = opted_out.select(F.lower(F.trim("value")).alias("value")).distinct()
    left = emails.join(values, emails["email"] == values["value"], "left_anti")
    return left.join(values, left["domain"] == values["value"], "left_anti")
