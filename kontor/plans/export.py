"""Addresses and telephones with their businesses, ranked, each once."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kontor.functions.email import kind_rank
from kontor.operators.state import first_of_each
from kontor.policy import LEAD_COLUMNS, PHONE_COLUMNS

BUSINESS_FIELDS = ("name", "category", "address", "postal_code", "city", "phone", "website", "siren", "naf", "source")


def _business_by_site(businesses: DataFrame, guesses: DataFrame) -> DataFrame:
    """(site_key, b): the first business of a site; where there is none, the first whose guess of it was confirmed."""
    fields = F.struct(*BUSINESS_FIELDS).alias("b")
    direct = businesses.where("site_key IS NOT NULL AND site_key <> ''").select("site_key", "id", fields, F.lit(0).alias("how"))
    confirmed = guesses.where("verified").select("business_id", F.col("site_key").alias("key"))
    guessed = confirmed.join(businesses, confirmed["business_id"] == businesses["id"]).select(F.col("key").alias("site_key"), "id", fields, F.lit(1).alias("how"))
    return first_of_each(direct.union(guessed), ["site_key"], "how", "id").select("site_key", F.col("b").alias("by_site"))


def site_phones(phones: DataFrame) -> DataFrame:
    """(site_key, phones): three numbers of each site, in order."""
    return phones.groupBy("site_key").agg(F.array_join(F.slice(F.sort_array(F.collect_set("phone")), 1, 3), " / ").alias("phones"))


def _or_empty(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def leads(
    emails: DataFrame, businesses: DataFrame, guesses: DataFrame, mx: DataFrame, phones: DataFrame,
    pro_only: bool = False, mx_only: bool = False, categories: list[str] | None = None, dedupe: bool = True, role_only: bool = False,
) -> DataFrame:
    """One row for each address (or for each place it was found), best first: LEAD_COLUMNS in their final order."""
    rows = emails.where("kind <> 'gratuit'") if pro_only else emails
    rows = rows.where("is_role") if role_only else rows
    by_id = businesses.select(F.col("id").alias("business_id"), F.struct(*BUSINESS_FIELDS).alias("by_id"))
    rows = rows.join(by_id, "business_id", "left").join(_business_by_site(businesses, guesses), "site_key", "left")
    rows = rows.join(mx.select("domain", F.col("ok").alias("takes_mail")), "domain", "left").join(site_phones(phones), "site_key", "left")
    rows = rows.where("takes_mail") if mx_only else rows
    rows = rows.withColumn("b", F.when(F.col("business_id") != 0, F.col("by_id")).otherwise(F.col("by_site")))
    if categories:
        rows = rows.where(F.col("b.category").isin(*categories))
    none = F.col("b").isNull()
    of = lambda c: F.when(none, "").otherwise(F.col(f"b.{c}"))
    site = F.when(F.col("site_key") != "", F.concat(F.lit("https://"), "site_key", F.lit("/"))).otherwise("")
    rows = rows.select(
        "email",
        F.col("kind").alias("type_email"),
        F.when(F.col("is_role"), "oui").otherwise("non").alias("generique"),
        F.when(F.col("takes_mail"), "ok").when(~F.col("takes_mail"), "invalide").otherwise("non vérifié").alias("mx"),
        *(of(c).alias(to) for c, to in zip(("name", "category", "address", "postal_code", "city", "phone"), ("entreprise", "categorie", "adresse", "code_postal", "ville", "telephone"))),
        _or_empty("phones").alias("telephone_site"),
        F.coalesce(F.nullif(of("website"), F.lit("")), site).alias("site_web"),
        *(of(c).alias(c) for c in ("siren", "naf", "source")),
        _or_empty("source_url").alias("page_source"),
        kind_rank(F.col("kind")).alias("rank"),
        F.coalesce(F.when(none, "").otherwise(F.col("b.name")) == "", F.lit(False)).alias("nameless"),
        "ingest_seq",
    )
    if dedupe:
        rows = first_of_each(rows, ["email"], "rank", "nameless", "ingest_seq", "page_source")
    rows = rows.withColumns({c: _or_empty(c) for c in LEAD_COLUMNS})
    return rows.orderBy("categorie", "code_postal", "entreprise", "rank", "email", "ingest_seq", "page_source").select(*LEAD_COLUMNS)


def phone_rows(businesses: DataFrame, emails: DataFrame, guesses: DataFrame, phones: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """One row for each business with a telephone, its own or its site's; a site without own numbers counts once: PHONE_COLUMNS."""
    confirmed = guesses.where("verified").groupBy(F.col("business_id").alias("id")).agg(F.min("site_key").alias("guess"))
    rows = businesses.join(confirmed, "id", "left").withColumn("key", F.coalesce(F.nullif("site_key", F.lit("")), "guess", F.lit("")))
    rows = rows.join(site_phones(phones).withColumnRenamed("site_key", "key"), "key", "left")
    own = _or_empty("phone") != ""
    rows = rows.where(own | F.col("phones").isNotNull())
    rows = rows.where(F.col("category").isin(*categories)) if categories else rows
    chain = (F.col("key") != "") & ~own
    rows = rows.where(~chain).unionByName(first_of_each(rows.where(chain), ["key"], "id"))
    ordered = lambda key: F.transform(F.sort_array(F.collect_list(F.struct("ingest_seq", "email"))), lambda x: x["email"])
    by_business = emails.where("business_id <> 0").groupBy(F.col("business_id").alias("id")).agg(ordered("id").alias("of_business"))
    by_site = emails.where("site_key <> ''").groupBy(F.col("site_key").alias("key")).agg(ordered("key").alias("of_site"))
    rows = rows.join(by_business, "id", "left").join(by_site, "key", "left")
    empty = F.array().cast("array<string>")
    every = F.array_distinct(F.concat(F.coalesce("of_business", empty), F.coalesce("of_site", empty)))
    site = F.when(F.col("key") != "", F.concat(F.lit("https://"), "key", F.lit("/"))).otherwise("")
    return rows.select(
        *(_or_empty(c).alias(to) for c, to in zip(("name", "category", "address", "postal_code", "city", "phone"), PHONE_COLUMNS)),
        _or_empty("phones").alias("telephone_site"),
        F.array_join(every, " / ").alias("emails"),
        F.coalesce(F.nullif("website", F.lit("")), site).alias("site_web"),
        *(_or_empty(c).alias(c) for c in ("siren", "naf", "source")),
        "id",
    ).orderBy("categorie", "code_postal", "entreprise", "id").select(*PHONE_COLUMNS)


def stats(businesses: DataFrame, sites: DataFrame, emails: DataFrame, mx: DataFrame) -> DataFrame:
    """(metric, key, value): what the tables hold."""
    count = F.count("*").cast("long").alias("value")
    by = lambda df, c, name, value=count: df.groupBy(F.col(c).alias("key")).agg(value).select(F.lit(name).alias("metric"), "key", "value")
    different = F.countDistinct("email").cast("long").alias("value")
    answers = F.when(F.col("ok"), "ok").when(~F.col("ok"), "ko").otherwise("?")
    parts = [
        by(businesses, "source", "businesses by source"),
        by(businesses, "category", "businesses by category"),
        by(sites, "status", "sites by status"),
        by(emails, "kind", "addresses by kind", different),
        emails.agg(different).select(F.lit("addresses").alias("metric"), F.lit("all").alias("key"), "value"),
        by(mx.withColumn("answer", answers), "answer", "domains by answer"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_csv(rows: DataFrame, path: str, sep: str = ";") -> int:
    """One CSV file that spreadsheets open as UTF-8, rows in their order; returns their number. Rows are streamed, not collected."""
    n = 0
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f, delimiter=sep)
        out.writerow(rows.columns)
        for row in rows.toLocalIterator():
            out.writerow(row)
            n += 1
    return n


def write_csv_parts(rows: DataFrame, folder: str, sep: str = ";") -> None:
    """CSV files in any shared store, one for each partition of the sorted rows, each with its header."""
    rows.write.option("header", True).option("sep", sep).csv(folder)
