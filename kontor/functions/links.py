"""Links of pages: contact pages, internal pages, other businesses' sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kontor.functions import text as T
from kontor.functions.url import authority_of, domain_in, host_of, path_of, query_of, registrable, scheme_of
from kontor.policy import DEFAULT, MAX_SCAN, SITEMAP_HINT, SKIPPED_FILES, ContactPolicy

# Anchors are found by their opening tags; each is then cut with what follows it.
OPEN = r"(?is)<a\b([^>]*)>(?=(.{0,300}))"
MAX_ANCHORS, MAX_INTERNAL_ANCHORS = 3001, 5001


def anchors(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html", limit: int = MAX_ANCHORS) -> DataFrame:
    """(page, base, pos, target, shown): each link of a page, resolved, with its text. Pages keep their own columns out of the way."""
    scanned = F.left(F.col(html), F.lit(MAX_SCAN))
    attributes, tails = (F.slice(F.regexp_extract_all(scanned, F.lit(OPEN), F.lit(g)), 1, limit) for g in (1, 2))
    rows = pages.select(F.col(page).alias("page"), F.col(url).alias("base"), F.posexplode(F.arrays_zip(attributes.alias("a"), tails.alias("t"))).alias("pos", "anchor"))
    attribute, tail = F.col("anchor").getField("a"), F.col("anchor").getField("t")
    hrefs = [F.regexp_extract(attribute, r"(?i)href\s*=\s*" + p, 1) for p in (r'"([^"]*)"', r"'([^']*)'", r"([^\s>\"'][^\s>]*)")]
    quoted = attribute.rlike(r"(?i)href\s*=\s*[\"']")
    href = F.when(quoted, F.concat(hrefs[0], F.when(hrefs[0] == "", hrefs[1]).otherwise(""))).otherwise(hrefs[2])
    shown = F.regexp_replace(F.regexp_extract(tail, r"(?is)^(.*?)(?:</a|\z)", 1), "<[^>]+>", " ")
    rows = rows.where(attribute.rlike(r"(?i)href\s*=")).select("page", "base", "pos", href.alias("href"), shown.alias("shown"))
    rows = rows.withColumns({c: F.coalesce(T.html_unescape(F.when(F.col(c).contains("&"), F.col(c))), F.col(c)) for c in ("href", "shown")})
    rows = rows.withColumn("href", F.regexp_replace("href", r"(?U)^\s+|\s+\z", "")).where("href <> ''")
    rows = rows.where(~F.col("href").rlike(r"^(?:#|mailto:|tel:|javascript:|data:)"))
    # Absolute references need no resolving; Python sees the others only.
    whole = F.col("href").rlike(r"^(?i:https?)://[^/?#]+/[^?#]*") & ~F.col("href").contains("/.")
    joined = T.url_join(F.when(~whole, F.col("base")), F.when(~whole, F.col("href")))
    return rows.withColumn("target", F.when(whole, F.col("href")).otherwise(joined)).where("target IS NOT NULL").select("page", "base", "pos", "href", "target", "shown")


def _clean(url: Column) -> Column:
    path, query = path_of(url), query_of(url)
    return F.concat(scheme_of(url), F.lit("://"), authority_of(url), F.when(path == "", "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _inner(links: DataFrame, policy: ContactPolicy) -> DataFrame:
    same = registrable(host_of(F.col("target")), policy) == registrable(host_of(F.col("base")), policy)
    return links.where(scheme_of(F.col("target")).isin("http", "https") & same & ~path_of(F.col("target")).rlike("(?i)" + SKIPPED_FILES))


def _decoded_path(url: Column) -> Column:
    path = path_of(url)
    return F.coalesce(T.percent_decode(F.when(path.contains("%"), path)), path)


def contact_score(shown: Column, policy: ContactPolicy = DEFAULT) -> Column:
    """The highest score of the hints that a text fits, or 0."""
    return F.greatest(*(F.when(shown.rlike("(?iUu)" + p), s).otherwise(0) for p, s in policy.contact_hints), F.lit(0))


def discover_links(links: DataFrame, limit: int = 12, policy: ContactPolicy = DEFAULT) -> DataFrame:
    """(page, url, score, rank): a page's links to contact pages of the same site, best first."""
    score = contact_score(F.concat_ws(" ", _decoded_path(F.col("target")), F.regexp_replace("shown", r"(?U)^\s+|\s+\z", "")), policy)
    scored = _inner(links, policy).select("page", "pos", _clean(F.col("target")).alias("url"), score.alias("score")).where("score > 0")
    best = scored.groupBy("page", "url").agg(F.max("score").alias("score"), F.min("pos").alias("pos"))
    rank = F.row_number().over(Window.partitionBy("page").orderBy(F.col("score").desc(), "pos"))
    return best.withColumn("rank", rank).where(F.col("rank") <= limit).select("page", "url", "score", "rank")


def internal_links(links: DataFrame, limit: int = 300, policy: ContactPolicy = DEFAULT) -> DataFrame:
    """(page, url, rank): the first `limit` links within the site, those of branches before others."""
    branch = F.when(_decoded_path(F.col("target")).rlike("(?iUu)" + policy.branch_link), 0).otherwise(1)
    found = _inner(links, policy).select("page", "pos", _clean(F.col("target")).alias("url"), branch.alias("late"))
    first = found.groupBy("page", "url").agg(F.min(F.struct("pos", "late")).alias("first")).select("page", "url", "first.pos", "first.late")
    by = Window.partitionBy("page")
    kept = first.withColumn("seen", F.row_number().over(by.orderBy("pos"))).where(F.col("seen") <= limit)
    return kept.withColumn("rank", F.row_number().over(by.orderBy("late", "pos"))).select("page", "url", "rank")


def external_sites(links: DataFrame, limit: int = 30, policy: ContactPolicy = DEFAULT) -> DataFrame:
    """(page, url): home pages of other businesses of the sector that a page links to."""
    host = host_of(F.col("target"))
    own, other = registrable(host_of(F.col("base")), policy), registrable(host, policy)
    fits = F.concat_ws(" ", "shown", other).rlike("(?iUu)" + policy.sector_link)
    found = links.where(F.col("href").rlike("^https?://") & (other != "") & (other != own) & ~domain_in(host, policy.blocked_sites) & ~path_of(F.col("target")).rlike("(?i)" + SKIPPED_FILES) & fits)
    home = F.concat(scheme_of(F.col("target")), F.lit("://"), authority_of(F.col("target")), F.lit("/"))
    first = found.groupBy("page", home.alias("url")).agg(F.min("pos").alias("pos"))
    rank = F.row_number().over(Window.partitionBy("page").orderBy("pos"))
    return first.withColumn("rank", rank).where(F.col("rank") <= limit).select("page", "url")


def sitemap_locations(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?iU)<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))


def is_contact_location(url: Column) -> Column:
    return url.rlike("(?i)" + SITEMAP_HINT)
