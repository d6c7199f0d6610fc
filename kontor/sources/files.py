"""Site lists: text files with a site on each line, and CSV files whose headers go by many names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kontor.functions.url import site_from_url
from kontor.policy import DEFAULT, ContactPolicy
from kontor.schemas import businesses_like

# Names of headers, best first.
HEADERS = {
    "url": "website site site_web siteweb url domain domaine web".split(),
    "name": "name nom entreprise raison_sociale societe company".split(),
    "city": "city ville commune".split(),
    "postal_code": "postal_code code_postal cp zip".split(),
}


def separator(spark: SparkSession, path: str) -> str:
    """Of comma, semicolon and tab, the one that the first line has most of."""
    first = spark.read.text(path).limit(1).collect()
    line = first[0][0] if first else ""
    return max(",;\t", key=line.count)


def _picked(columns: list[str], names: list[str]) -> Column:
    """The first of some headers that a row has a value for, trimmed."""
    plain = {c.strip().lstrip("﻿").lower().replace(" ", "_").replace("-", "_"): c for c in columns}
    found = [F.nullif(F.col(f"`{plain[n]}`"), F.lit("")) for n in names if n in plain]
    return F.regexp_replace(F.coalesce(*found, F.lit("")), r"(?U)^\s+|\s+\z", "")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """(url, name, city, postal_code, ingest_seq)"""
    rows = spark.read.option("header", True).option("sep", separator(spark, path)).option("multiLine", True).csv(path)
    return rows.select(*(_picked(rows.columns, names).alias(to) for to, names in HEADERS.items()), _line().alias("ingest_seq"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same columns from a text file: blank lines and lines that start with # are none."""
    rows = spark.read.text(path).withColumn("ingest_seq", _line())
    rows = rows.where(~F.startswith("value", F.lit("#"))).select(F.regexp_replace("value", r"(?U)^[\s﻿]+|\s+\z", "").alias("url"), "ingest_seq")
    return rows.where("url <> ''").select("url", *(F.lit("").alias(c) for c in ("name", "city", "postal_code")), "ingest_seq")


def _line() -> Column:
    """An order within small lists: file positions as Spark reads them."""
    return F.monotonically_increasing_id()


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path) if path.lower().endswith(".csv") else read_lines(spark, path)


def businesses(rows: DataFrame, category: str = "autre", policy: ContactPolicy = DEFAULT) -> DataFrame:
    """Sites of a list as businesses; unusable and blocked ones go."""
    rows = rows.withColumn("site", site_from_url(F.col("url"), policy)).where("site.site_key IS NOT NULL")
    return businesses_like(
        rows.select(
            F.lit("file").alias("source"),
            F.col("site.site_key").alias("source_id"),
            F.coalesce(F.nullif("name", F.lit("")), "site.site_key").alias("name"),
            F.lit(category).alias("category"),
            "city",
            "postal_code",
            F.col("site.url").alias("website"),
            "ingest_seq",
        )
    )
