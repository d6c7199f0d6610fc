"""Sources into the tables of businesses, sites and known addresses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontor.functions import email as E
from kontor.functions.url import host_of, registrable, site_from_url
from kontor.operators.numbering import numbered
from kontor.operators.state import add_new
from kontor.policy import DEFAULT, ContactPolicy
from kontor.schemas import businesses_like

#: Where several sources bring a site, the first in this order names it.
SOURCE_ORDER = ("file", "osm", "sirene", "gmaps", "search", "lien")


def union_sources(sources: list[DataFrame]) -> DataFrame:
    """All sources as one table, with an order that is that of sources first."""
    rows = reduce(DataFrame.unionByName, map(businesses_like, sources))
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, SOURCE_ORDER)), F.col("source")), F.lit(0)), F.lit(len(SOURCE_ORDER) + 1))
    return rows.withColumn("source_place", place)


def canonical(rows: DataFrame, policy: ContactPolicy = DEFAULT) -> DataFrame:
    """Rows with site_key, and the site's address as website where there is one."""
    site = site_from_url(F.col("website"), policy)
    rows = rows.withColumn("_site", site)
    return rows.withColumns({"site_key": F.col("_site.site_key"), "website": F.coalesce("_site.url", "website", F.lit(""))}).drop("_site")


def collect(existing: DataFrame, sources: list[DataFrame], policy: ContactPolicy = DEFAULT) -> DataFrame:
    """The new businesses (source, source_id not there yet), first row of each, to be appended; ids go on from the greatest."""
    rows = canonical(union_sources(sources), policy)
    order = ("source_place", F.col("ingest_seq").asc_nulls_last(), "name", "website", "address")
    new = add_new(existing, rows, ["source", "source_id"], *order)
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return numbered(new, "id", "source_place", F.col("ingest_seq").asc_nulls_last(), "source_id", start=top + 1).drop("source_place")


def sites_of(existing: DataFrame, businesses: DataFrame) -> DataFrame:
    """The new sites of new businesses, pending; the first business of a site gives the address."""
    rows = businesses.where("site_key IS NOT NULL").select(
        "site_key", F.col("website").alias("url"), F.lit(False).alias("guessed"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("final_url"), F.lit(0).cast("long").alias("pages"), F.col("id").alias("ingest_seq")
    )
    return add_new(existing, rows, ["site_key"], "ingest_seq")


def emails_of(existing: DataFrame, businesses: DataFrame, policy: ContactPolicy = DEFAULT) -> DataFrame:
    """The addresses that sources already know, attached to their business."""
    rows = businesses.select("id", "source", "website", "site_key", F.explode("emails").alias("raw")).withColumn("email", E.clean_email(F.col("raw"), policy)).where("email IS NOT NULL")
    own = F.when(F.col("site_key").isNotNull(), F.array(registrable(host_of(F.col("website")), policy))).otherwise(F.array().cast("array<string>"))
    rows = rows.select(*email_columns("email", F.lit(""), F.col("id"), own, F.col("source"), F.col("id"), policy))
    return add_new(existing, rows, ["email", "site_key", "business_id"], "ingest_seq")


def email_columns(email: str, site_key, business_id, site_domains, source_url, seq, policy: ContactPolicy = DEFAULT) -> list:
    """The columns of the table of addresses; kind and role are those of the first time an address is found."""
    e = F.col(email)
    return [
        e.alias("email"),
        E.domain_of(e).alias("domain"),
        site_key.alias("site_key"),
        business_id.cast("long").alias("business_id"),
        E.email_kind(e, site_domains, policy).alias("kind"),
        E.is_role(e, policy).alias("is_role"),
        source_url.alias("source_url"),
        seq.cast("long").alias("ingest_seq"),
    ]


def categories(spark, policy: ContactPolicy = DEFAULT) -> DataFrame:
    """(category, label, naf, tags, keywords)"""
    rows = [(n, c[0], " ".join(c[1]) or "-", " ".join(f"{k}={v}" for k, v in c[2]) or "-", ", ".join(c[3]) or "-") for n, c in policy.categories.items()]
    return spark.createDataFrame(rows, "category string, label string, naf string, tags string, keywords string")
