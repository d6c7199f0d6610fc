"""Hits of a search engine, and sites that other sites link to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontor.functions.url import authority_of, host_of, scheme_of, site_from_url
from kontor.policy import DEFAULT, ContactPolicy
from kontor.schemas import businesses_like

MAX_PAGES = 10


def businesses(hits: DataFrame, country: str = "FR", policy: ContactPolicy = DEFAULT) -> DataFrame:
    """From hits (url, title, category, city, ingest_seq); unusable and blocked sites go."""
    rows = hits.withColumn("key", site_from_url(F.col("url"), policy)["site_key"]).where("key IS NOT NULL")
    return businesses_like(
        rows.select(
            F.lit("search").alias("source"),
            F.col("key").alias("source_id"),
            F.left(F.coalesce("title", F.lit("")), F.lit(200)).alias("name"),
            "category",
            "city",
            F.lit(country).alias("country"),
            F.concat(scheme_of(F.col("url")), F.lit("://"), authority_of(F.col("url")), F.lit("/")).alias("website"),
            "ingest_seq",
        )
    )


def partners(sites: DataFrame) -> DataFrame:
    """Businesses known only by a link: (url, ingest_seq)."""
    rows = sites.select(F.lit("lien").alias("source"), F.col("url").alias("source_id"), host_of(F.col("url")).alias("name"), F.lit("partenaire").alias("category"), F.col("url").alias("website"), "ingest_seq")
    return businesses_like(rows)
