"""Reading sites from recorded pages, stage by stage, all sites at once.

A stage wants URLs for sites; those not seen before, within the site's budget, are looked up in the recorded pages.
Stages come one after the other as a reader would go on: home page, contact pages, contact pages of those, usual paths
and the site map only where no address was found, and at last, for networks, every page by breadth. The number of
stages is fixed but for the last, which ends where no page is new or left, and tables between them are cut from their lineage.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kontor.functions import links as L
from kontor.functions import text as T
from kontor.functions.email import with_emails
from kontor.functions.names import verify_tokens
from kontor.functions.phone import extract_phones
from kontor.functions.url import authority_of, home_candidates, host_of, page_identity, registrable, scheme_of
from kontor.operators.state import add_new, cut, first_of_each, network_sites, pending
from kontor.plans.collect import email_columns
from kontor.policy import DEFAULT, FALLBACK_PATHS, MAX_BODY, MAX_ROBOTS, MAX_TEXT, ContactPolicy
from kontor.sources.search import partners as partner_businesses

READABLE = ("html", "text/plain", "xml", "vcard", "directory")


def permitted(pages: DataFrame, robots: DataFrame | None = None, agent: str = "*") -> DataFrame:
    """Recorded pages (url, status, content_type, html or body and charset, ...) that may and can be read, row by row: a URL may be recorded more than once."""
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    fits = kind == ""
    for name in READABLE:
        fits |= kind.contains(name)
    rows = pages.where((F.coalesce("status", F.lit(200)) < 400) & fits)
    if "html" not in rows.columns:
        rows = rows.withColumn("html", T.decode_body(F.substring("body", 1, MAX_BODY), F.col("charset")))
    if robots is not None:
        origin = F.concat(scheme_of(F.col("url")), F.lit("://"), authority_of(F.col("url")))
        rules = robots.select(F.col("origin").alias("_origin"), F.col("status").alias("_status"), F.left("body", F.lit(MAX_ROBOTS)).alias("_rules"))
        rows = rows.join(rules, origin == F.col("_origin"), "left")
        rows = rows.where(F.col("_origin").isNull() | T.can_fetch(F.col("_status"), F.col("_rules"), F.lit(agent), F.col("url"))).drop("_origin", "_status", "_rules")
    return rows.where("html IS NOT NULL")


def readable(pages: DataFrame, robots: DataFrame | None = None, agent: str = "*") -> DataFrame:
    """(url, html): of every URL the least text among its permitted records."""
    return first_of_each(permitted(pages, robots, agent).select("url", "html"), ["url"], "html")


@dataclass
class Visit:
    """What a round has read: `seen` (site_key, identity), `read` (site_key, stage, ord, url, html)."""

    pages: DataFrame
    seen: DataFrame
    read: DataFrame

    def counts(self) -> DataFrame:
        return self.read.groupBy("site_key").agg(F.count("*").alias("n"))

    def fetch(self, wanted: DataFrame, budget: DataFrame, stage: int) -> DataFrame:
        """Reads (site_key, url, ord) as far as they are new and the budget (site_key, most) allows; returns what was read."""
        new = wanted.withColumn("identity", page_identity(F.col("url"))).join(self.seen, ["site_key", "identity"], "left_anti")
        new = first_of_each(new, ["site_key", "identity"], "ord", "url").join(budget, "site_key").join(self.counts(), "site_key", "left")
        place = F.row_number().over(Window.partitionBy("site_key").orderBy("ord", "url"))
        tried = cut(new.withColumn("place", place).where(F.col("place") <= F.col("most") - F.coalesce("n", F.lit(0))).select("site_key", "url", "identity", "place"))
        if tried.isEmpty():
            return self.read.limit(0)
        got = tried.join(self.pages, "url").select("site_key", F.lit(stage).alias("stage"), F.col("place").cast("long").alias("ord"), "url", "html")
        got = cut(got)
        self.seen = cut(self.seen.union(tried.select("site_key", "identity")).distinct())
        self.read = self.read.union(got)
        return got


def _links(read: DataFrame, find, policy: ContactPolicy) -> DataFrame:
    """(site_key, url, ord) of the links that `find` sees on pages, by page and rank."""
    pages = read.select(F.struct("site_key", "stage", "ord", "url").alias("page_id"), "url", "html")
    found = find(L.anchors(pages), policy=policy)
    return found.select(F.col("page.site_key").alias("site_key"), "url", (F.col("page.stage").cast("long") * 10**9 + F.col("page.ord") * 10**4 + F.col("rank")).alias("ord"))


def without_email(read: DataFrame, policy: ContactPolicy) -> DataFrame:
    """(site_key) of the sites whose pages so far hold no address."""
    some = F.max(F.size("emails") > 0).alias("some")
    return with_emails(read.select("site_key", "html"), policy=policy).groupBy("site_key").agg(some).where("NOT some").select("site_key")


def visit(sites: DataFrame, pages: DataFrame, deep: DataFrame | None = None, max_pages: int = 10, deep_pages: int = 60, deep_rounds: int | None = None, policy: ContactPolicy = DEFAULT) -> DataFrame:
    """(site_key, stage, ord, url, html): the pages read of each site (site_key, url). deep: (site_key) of sites to read as a whole, as long as there are new links and pages left, or for so many rounds."""
    tries = sites.select("site_key", F.col("url").alias("start"), F.posexplode(home_candidates(F.col("url"))).alias("ord", "url"))
    home = first_of_each(tries.join(pages, "url"), ["site_key"], "ord")
    home = cut(home.select("site_key", "start", F.lit(0).alias("stage"), F.lit(0).cast("long").alias("ord"), "url", "html"))
    seen = home.select("site_key", F.explode(F.array(page_identity(F.col("url")), page_identity(F.col("start")))).alias("identity")).distinct()
    home = home.drop("start")
    v = Visit(pages, cut(seen), home)
    every = home.select("site_key", F.lit(max_pages).alias("most"))
    first = v.fetch(_links(home, L.discover_links, policy), every, 1)
    if not first.isEmpty():
        v.fetch(_links(first, L.discover_links, policy), every, 2)
    bare = cut(without_email(v.read, policy))
    origin = F.concat(scheme_of(F.col("url")), F.lit("://"), authority_of(F.col("url")))
    if not bare.isEmpty():
        usual = home.join(bare, "site_key", "left_semi").select("site_key", origin.alias("origin"), F.posexplode(F.array(*map(F.lit, FALLBACK_PATHS))).alias("ord", "path"))
        v.fetch(usual.select("site_key", F.concat("origin", "path").alias("url"), "ord"), every, 3)
        bare = cut(without_email(v.read, policy))
        v.fetch(sitemap_pages(home.join(bare, "site_key", "left_semi").select("site_key", origin.alias("origin")), pages), every, 4)
    if deep is not None:
        most = home.join(deep, "site_key", "left_semi").select("site_key", F.lit(deep_pages).alias("most"))
        frontier = home.union(first).join(deep, "site_key", "left_semi")
        turn = 0
        while deep_rounds is None or turn < deep_rounds:  # ends with the frontier or the budget, which both only shrink
            frontier = v.fetch(_links(frontier, L.internal_links, policy), most, 5 + turn)
            if frontier.isEmpty():
                break
            turn += 1
    return v.read


def sitemap_pages(origins: DataFrame, pages: DataFrame, limit: int = 6) -> DataFrame:
    """(site_key, url, ord): contact-like pages that site maps (site_key, origin) name; two maps within a map are opened."""
    maps = origins.select("site_key", F.posexplode(F.array(*(F.concat("origin", F.lit(p)) for p in ("/sitemap.xml", "/sitemap_index.xml")))).alias("which", "url"))
    top = maps.join(pages, "url").select("site_key", "which", F.posexplode(L.sitemap_locations(F.col("html"))).alias("ord", "url"))
    inner = top.where(F.endswith("url", F.lit(".xml")) & L.is_contact_location(F.col("url")))
    turn = F.row_number().over(Window.partitionBy("site_key", "which").orderBy("ord"))
    inner = inner.withColumn("turn", turn).where("turn <= 2").join(pages, "url")
    below = inner.select("site_key", "which", "turn", F.posexplode(L.sitemap_locations(F.col("html"))).alias("ord", "url"))
    every = top.withColumn("turn", F.lit(0)).unionByName(below).where(~F.endswith("url", F.lit(".xml")) & L.is_contact_location(F.col("url")))
    every = every.withColumn("least", F.min("which").over(Window.partitionBy("site_key"))).where("which = least")
    place = F.row_number().over(Window.partitionBy("site_key").orderBy("turn", "ord"))
    return every.withColumn("ord", place).where(F.col("ord") <= limit).select("site_key", "url", "ord")


@dataclass
class Round:
    """What a round adds: rows to append, and what it says of sites and guesses."""

    emails: DataFrame
    phones: DataFrame
    sites: DataFrame
    confirmed: DataFrame
    partners: DataFrame


def crawl(sites: DataFrame, pages: DataFrame, guesses: DataFrame, deep: DataFrame | None = None, policy: ContactPolicy = DEFAULT, **limits) -> Round:
    """Reads sites (site_key, url, guessed). Pages of a guessed site count only if a token proves an owner."""
    read = cut(visit(sites, pages, deep, policy=policy, **limits))
    guessed = sites.where("guessed").select("site_key")
    owners = read.join(guessed, "site_key", "left_semi").join(guesses.select("business_id", "site_key", "tokens"), "site_key")
    proven = owners.groupBy("business_id", "site_key").agg(F.max(verify_tokens(F.left("html", F.lit(MAX_TEXT)), F.col("tokens"))).alias("ok")).where("ok")
    homes = read.where("stage = 0").select("site_key", F.col("url").alias("final_url"))
    confirmed = cut(proven.join(homes, "site_key").select("business_id", "site_key", F.col("final_url").alias("url")))
    refused = guessed.join(confirmed, "site_key", "left_anti")
    kept = read.join(refused, "site_key", "left_anti").join(sites.select("site_key", F.col("url").alias("start")), "site_key").join(homes, "site_key")
    domains = F.array_remove(F.array_distinct(F.array(*(registrable(host_of(F.col(c)), policy) for c in ("start", "final_url")))), "")
    order = F.col("stage").cast("long") * 10**6 + F.col("ord")
    found = with_emails(kept.select("site_key", "url", order.alias("seq"), domains.alias("own"), "html"), policy=policy)
    found = found.select("site_key", "url", "seq", "own", F.explode("emails").alias("email"))
    found = first_of_each(found, ["site_key", "email"], "seq", "url")
    emails = found.select(*email_columns("email", F.col("site_key"), F.lit(0), F.col("own"), F.col("url"), F.col("seq"), policy))
    phones = kept.select("site_key", F.explode(extract_phones(F.col("html"))).alias("phone")).distinct()
    counted = read.groupBy("site_key").agg(F.count("*").alias("pages")).join(homes, "site_key")
    status = sites.select("site_key", "guessed").join(counted, "site_key", "left").join(confirmed.select("site_key").distinct().withColumn("sure", F.lit(True)), "site_key", "left")
    says = F.when(F.col("pages").isNull(), "unreachable").when(F.col("guessed") & F.col("sure").isNull(), "unverified").otherwise("ok")
    outer = L.external_sites(L.anchors(kept.select(F.col("site_key").alias("page_id"), "url", "html")), policy=policy)
    return Round(emails, phones, status.select("site_key", says.alias("status"), "final_url", F.coalesce("pages", F.lit(0)).alias("pages")), confirmed, outer.select("url").distinct())


def rounds(sites: DataFrame, businesses: DataFrame, pages: DataFrame, guesses: DataFrame, most: int = 3, policy: ContactPolicy = DEFAULT, limit: int | None = None, deep: bool = False, **limits):
    """Up to `most` rounds: each reads what is pending, and the sites that it finds linked are pending for the next.

    limit bounds the sites of the first round; deep reads every site as a whole, not those of networks only. Returns
    (emails, phones, says, confirmed, partners): the rows of all rounds; partners as businesses to collect.
    """
    from kontor.plans.collect import canonical

    waiting, known = pending(sites, limit), sites.select("site_key")
    networks = network_sites(businesses).select("site_key")
    parts: list[Round] = []
    found = None
    for turn in range(most):
        r = crawl(waiting.select("site_key", "url", "guessed"), pages, guesses, waiting.select("site_key") if deep else networks, policy, **limits)
        parts.append(r)
        new = canonical(partner_businesses(r.partners.withColumn("ingest_seq", F.lit(turn).cast("long"))), policy).where("site_key IS NOT NULL")
        new = cut(add_new(known, first_of_each(new, ["source_id"], "site_key"), ["site_key"], "source_id"))
        found = new if found is None else found.union(new)
        if turn + 1 == most or new.isEmpty():
            break
        known = known.union(new.select("site_key"))
        waiting = new.select("site_key", F.col("website").alias("url"), F.lit(False).alias("guessed"))
    union = lambda name: _union([getattr(p, name) for p in parts])
    return union("emails"), union("phones").distinct(), union("sites"), union("confirmed"), found


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
