"""Sites of businesses that have none: domains that exist among those the name suggests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontor.functions.names import business_tokens, candidate_domains, words
from kontor.operators.state import add_new, first_of_each
from kontor.policy import DEFAULT, ContactPolicy


def to_guess(businesses: DataFrame, emails: DataFrame, limit: int | None = None) -> DataFrame:
    """Businesses with neither site nor address."""
    known = emails.where("business_id <> 0").select(F.col("business_id").alias("id")).distinct()
    found = businesses.where("site_key IS NULL").join(known, "id", "left_anti")
    return found.orderBy("id").limit(limit) if limit else found


def candidates(businesses: DataFrame, policy: ContactPolicy = DEFAULT) -> DataFrame:
    """(business_id, domain, tokens): every domain that a name or other name suggests, for businesses that a token can prove."""
    rows = businesses.withColumn("tokens", business_tokens(F.col("postal_code"), F.col("siren"))).where(F.size("tokens") > 0)
    town, name, other = (words(F.col(c), policy) for c in ("city", "name", "alt_name"))
    rows = rows.select("id", "tokens", name.alias("a"), other.alias("b"), town.alias("town"))
    both = F.array_union(candidate_domains(F.col("a"), F.col("town"), policy=policy), candidate_domains(F.col("b"), F.col("town"), policy=policy))
    return rows.select(F.col("id").alias("business_id"), F.explode(both).alias("domain"), "tokens")


def unknown(found: DataFrame, sites: DataFrame, checked: DataFrame) -> DataFrame:
    """Candidates that are neither a site nor a domain already looked up: filtered before anything is asked."""
    seen = sites.select(F.col("site_key").alias("domain")).union(checked.select("domain")).distinct()
    return found.join(seen, "domain", "left_anti")


def guess(businesses: DataFrame, sites: DataFrame, emails: DataFrame, checked: DataFrame, dns: DataFrame, guesses: DataFrame, limit: int | None = None, policy: ContactPolicy = DEFAULT):
    """(new sites, new guesses, new lookups). dns: recorded answers (domain, ok); no answer stays unknown and is asked again."""
    asked = unknown(candidates(to_guess(businesses, emails, limit), policy), sites, checked)
    answers = first_of_each(dns.where("ok IS NOT NULL"), ["domain"], "ok")
    found = asked.join(answers, "domain")
    lookups = found.select("domain", "ok").distinct()
    alive = found.where("ok")
    owners = alive.select("business_id", F.col("domain").alias("site_key"), "tokens", F.lit(False).alias("verified"))
    new_sites = alive.groupBy(F.col("domain").alias("site_key")).agg(F.min("business_id").alias("ingest_seq")).select(
        "site_key", F.concat(F.lit("https://"), "site_key", F.lit("/")).alias("url"), F.lit(True).alias("guessed"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("final_url"), F.lit(0).cast("long").alias("pages"), "ingest_seq"
    )
    return new_sites, add_new(guesses, owners, ["business_id", "site_key"], "site_key"), lookups
