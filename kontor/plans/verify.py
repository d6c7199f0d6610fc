"""Whether domains take mail: yes, no, or not known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kontor.operators.state import replace_rows


def domains_to_check(emails: DataFrame, mx: DataFrame, recheck: bool = False) -> DataFrame:
    """Domains of addresses that were never checked or stayed unknown; all with recheck."""
    domains = emails.select("domain").distinct()
    return domains if recheck else domains.join(mx.where("ok IS NOT NULL").select("domain"), "domain", "left_anti")


def mx_status(rcode: Column, hosts: Column, has_address: Column) -> Column:
    """True, false or null from a recorded answer: no such domain is no; no mail server but an address is yes; a lone dot refuses."""
    named = F.exists(F.coalesce(hosts, F.array().cast("array<string>")), lambda h: F.regexp_replace(h, r"\.+\z", "") != "")
    return F.when(rcode == "NOERROR", named).when(rcode == "NXDOMAIN", F.lit(False)).when(rcode == "NOANSWER", has_address)


def verify(emails: DataFrame, mx: DataFrame, answers: DataFrame, recheck: bool = False) -> DataFrame:
    """The table of domains after the recorded answers for those that were due; without an answer a domain is unknown."""
    asked = domains_to_check(emails, mx, recheck).join(answers, "domain", "left")
    new = asked.select("domain", mx_status(F.col("rcode"), F.col("hosts"), F.col("has_address")).alias("ok"), F.lit(0).cast("long").alias("ingest_seq"))
    return replace_rows(mx, new, ["domain"])
