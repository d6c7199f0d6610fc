"""A directory kept in a folder, and the stages that change it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from kontor.operators import state as S
from kontor.operators.store import Store
from kontor.plans import collect as C
from kontor.plans import crawl as R
from kontor.plans import export as X
from kontor.plans import guess as G
from kontor.plans import verify as V
from kontor.policy import CITIES, DEFAULT, PREFECTURES, ContactPolicy, departments


def parse_categories(text: str | None, policy: ContactPolicy = DEFAULT) -> list[str] | None:
    """Names of categories, separated by commas; none means all."""
    names = [x.strip() for x in (text or "").split(",") if x.strip()]
    if wrong := [x for x in names if x not in policy.categories]:
        raise ValueError(f"unknown categories: {', '.join(wrong)}")
    return names or None


def parse_departments(text: str | None) -> list[str] | None:
    """Codes of departments, separated by commas: upper case, of two places at least."""
    codes = [x.strip().upper().zfill(2) for x in (text or "").split(",") if x.strip()]
    if wrong := [x for x in codes if x not in departments()]:
        raise ValueError(f"unknown departments: {', '.join(wrong)}")
    return codes or None


def parse_cities(text: str | None) -> list[str]:
    """Towns, each once: the large ones by default, with all prefectures for `all`."""
    if not text:
        return list(CITIES)
    if text.strip().lower() == "all":
        return list(dict.fromkeys(CITIES + PREFECTURES))
    return list(dict.fromkeys(x.strip() for x in text.split(",") if x.strip()))


def resolve_sources(text: str = "auto", country: str = "FR", search_key: bool = False, places_key: bool = False, file: bool = False) -> set[str]:
    """Which sources to use: `auto` takes the open ones, and those whose key is there."""
    chosen = {x.strip() for x in text.split(",") if x.strip()}
    if "auto" in chosen:
        chosen = chosen - {"auto"} | {"osm"} | ({"sirene"} if country.upper() == "FR" else set()) | ({"search"} if search_key else set()) | ({"gmaps"} if places_key else set())
    if wrong := chosen - {"osm", "sirene", "search", "gmaps", "file"}:
        raise ValueError(f"unknown sources: {', '.join(sorted(wrong))}")
    return chosen | ({"file"} if file else set())


def in_departments(businesses: DataFrame, codes: list[str] | None) -> DataFrame:
    """Businesses whose postal code lies in one of the departments; all without codes. 2A and 2B share 20."""
    if not codes:
        return businesses
    starts = sorted({"20" if c in ("2A", "2B") else c for c in codes})
    return businesses.where(F.left("postal_code", F.lit(2)).isin(starts) | F.left("postal_code", F.lit(3)).isin(starts))


def may_guess(sources: set[str]) -> bool:
    """Sites are guessed only for sources that name companies without their sites."""
    return bool(sources & {"sirene", "gmaps"})


class Directory:
    """The stages over the tables of a folder. Each table is whole at any time, and what a stage is told by is kept last.

    So a stage that was interrupted does its work again when it is called again, and adds what is missing.
    """

    def __init__(self, spark: SparkSession, folder: str, policy: ContactPolicy = DEFAULT):
        self.spark, self.store, self.policy = spark, Store(spark, folder), policy

    def __getattr__(self, name: str) -> DataFrame:
        if name in self.store.names():
            return self.store.read(name)
        raise AttributeError(name)

    def collect(self, *sources: DataFrame) -> int:
        """Adds the businesses of sources (those of kontor.sources), their sites and known addresses; returns how many are new."""
        seen = Observation()
        new = S.cut(C.collect(self.businesses, list(sources), self.policy).observe(seen, F.count("*").alias("rows")))
        self.store.append("sites", C.sites_of(self.sites, new))
        self.store.append("emails", C.emails_of(self.emails, new, self.policy))
        self.store.append("businesses", new)
        return seen.get["rows"]

    def guess(self, dns: DataFrame, limit: int | None = None) -> int:
        """Adds sites that names suggest and recorded answers (domain, ok) confirm to exist; returns how many."""
        sites, owners, lookups = G.guess(self.businesses, self.sites, self.emails, self.dns_checked, dns, self.guesses, limit, self.policy)
        sites, owners, lookups = S.cut(sites), S.cut(owners), S.cut(lookups)
        self.store.append("sites", sites)
        self.store.append("guesses", owners)
        self.store.save("dns_checked", S.replace_rows(self.dns_checked, lookups.withColumn("ingest_seq", F.lit(0).cast("long")), ["domain"]))
        return sites.count()

    def crawl(self, pages: DataFrame, robots: DataFrame | None = None, agent: str = "kontor", most_rounds: int = 3, retry_failed: bool = False, again_without_email: bool = False, **limits) -> int:
        """Reads pending sites from recorded pages; returns how many addresses are new."""
        sites = S.reset_failed(self.sites) if retry_failed else self.sites
        sites = S.cut(S.reset_without_email(sites, self.emails) if again_without_email else sites)
        readable = S.cut(R.readable(pages, robots, agent))
        emails, phones, says, confirmed, partners = (S.cut(x) for x in R.rounds(sites, self.businesses, readable, self.guesses, most_rounds, self.policy, **limits))
        known = S.cut(C.collect(self.businesses, [partners.drop("site_key")], self.policy))
        sites = sites.unionByName(C.sites_of(sites, known))
        self.store.save("businesses", S.link_guessed(self.businesses.unionByName(known.select(*self.businesses.columns)), confirmed))
        self.store.save("sites", S.save_sites(sites, says))
        sure = confirmed.select("business_id", "site_key", F.lit(True).alias("_sure")).distinct()
        marked = self.guesses.join(sure, ["business_id", "site_key"], "left").withColumn("verified", F.col("verified") | F.coalesce("_sure", F.lit(False)))
        self.store.save("guesses", marked)
        seen = Observation()
        new = S.cut(S.add_new(self.emails, emails, ["email", "site_key", "business_id"], "ingest_seq").observe(seen, F.count("*").alias("rows")))
        self.store.append("emails", new)
        self.store.append("site_phones", S.add_new(self.site_phones, phones, ["site_key", "phone"], "phone"))
        return seen.get["rows"]

    def verify(self, answers: DataFrame, recheck: bool = False) -> None:
        """Keeps what recorded answers (kontor.schemas: mx_answers) say of the addresses' domains."""
        self.store.save("mx", S.cut(V.verify(self.emails, self.mx, answers, recheck)))

    def leads(self, opted_out: DataFrame | None = None, **options) -> DataFrame:
        emails = self.emails if opted_out is None else S.suppress(self.emails, opted_out)
        return X.leads(emails, self.businesses, self.guesses, self.mx, self.site_phones, **options)

    def phones(self, opted_out: DataFrame | None = None, **options) -> DataFrame:
        emails = self.emails if opted_out is None else S.suppress(self.emails, opted_out)
        return X.phone_rows(self.businesses, emails, self.guesses, self.site_phones, **options)

    def stats(self) -> DataFrame:
        return X.stats(self.businesses, self.sites, self.emails, self.mx)
