"""Entries of a places service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kontor.functions.names import refine_category
from kontor.policy import DEFAULT, ContactPolicy
from kontor.schemas import businesses_like


def _component(kind: str) -> Column:
    """The last address component of a type."""
    fitting = F.filter(F.coalesce("addressComponents", F.array()), lambda c: F.array_contains(c["types"], kind))
    return F.coalesce(F.try_element_at(fitting, F.lit(-1))["longText"], F.lit(""))


def businesses(entries: DataFrame, country: str = "FR", policy: ContactPolicy = DEFAULT) -> DataFrame:
    """From entries with the category that was asked for, as a column. Places closed for good go."""
    name = F.coalesce(F.col("displayName.text"), F.lit(""))
    rows = entries.where(F.coalesce("businessStatus", F.lit("")) != "CLOSED_PERMANENTLY")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return businesses_like(
        rows.select(
            F.lit("gmaps").alias("source"),
            F.col("id").alias("source_id"),
            name.alias("name"),
            refine_category(F.col("category"), name, policy).alias("category"),
            text("formattedAddress").alias("address"),
            _component("postal_code").alias("postal_code"),
            _component("locality").alias("city"),
            F.lit(country).alias("country"),
            text("nationalPhoneNumber").alias("phone"),
            text("websiteUri").alias("website"),
            F.col("location.latitude").alias("lat"),
            F.col("location.longitude").alias("lon"),
            F.lit(0).cast("long").alias("ingest_seq"),
        )
    )


def requests(spark: SparkSession, cities: list[str], categories: list[str] | None = None, keywords: list[str] | None = None, policy: ContactPolicy = DEFAULT) -> DataFrame:
    """(category, keyword, city, request): what to ask a places service or a search engine."""
    if keywords:
        asked = [("autre", k) for k in keywords]
    else:
        asked = [(name, k) for name in categories or policy.categories for k in policy.categories[name][3]]
    towns = spark.createDataFrame([(c,) for c in dict.fromkeys(cities)], "city string")
    grid = spark.createDataFrame(asked, "category string, keyword string").crossJoin(F.broadcast(towns))
    return grid.withColumn("request", F.concat_ws(" ", "keyword", "city"))
