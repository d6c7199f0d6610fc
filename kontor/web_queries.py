"""Registered queries over a recorded web that the synthetic tables give rise to, with the SQL that says what must come out.

The pages are made here; the SQL does not read them, it states for every row what its pages were made to hold.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontor.functions import links as L
from kontor.functions import text as T
from kontor.functions.email import with_emails
from kontor.functions.names import business_tokens
from kontor.operators import state as S
from kontor.operators.store import Store
from kontor.plans import collect as C
from kontor.plans import crawl as R
from kontor.plans import export as X
from kontor.plans import guess as G
from kontor.plans import verify as V
from kontor.plans.directory import Directory
from kontor.policy import FALLBACK_PATHS
from kontor.queries import DOMAINS, NAMES, ORACLE_SQL, QUERIES, TOWNS, _list, _register  # noqa: F401
from kontor.schemas import table
from kontor.sources import files, places, register, search

N = "CAST(c_custkey AS STRING)"
SITE = f"'s' || {N} || '.fr'"


def _folder(spark, name: str) -> str:
    return f"{S.shared_dir(spark)}/kontor/{name}-{uuid.uuid4().hex}"


def _pages(t, **of: str) -> DataFrame:
    """(url, html): of each customer, pages by path; an expression may be null, which is no page."""
    pairs = ", ".join(f"struct({path!r} AS path, {html} AS html)" for path, html in of.items())
    rows = t("customer").select("c_custkey", F.expr(f"inline(array({pairs}))"))
    return rows.where("html IS NOT NULL").select(F.expr(f"'https://' || {SITE} || path").alias("url"), "html")


# What a site is like goes by the remainder of its number: gone; under www.; with contact pages; with a usual path only;
# with a site map only; with pages that follow from one another.
HOME = """CASE c_custkey % 6 WHEN 2 THEN '<a href="/contact">Contact</a> <a href="/mentions-legales">Mentions</a> <a href="/contact.pdf">Contact</a> <a href="https://autre.fr/contact">Contact</a> <a href="mailto:x">x</a> <a href="/equipe">Equipe</a>'
  WHEN 3 THEN 'rien' WHEN 4 THEN 'rien' WHEN 5 THEN '<a href="/a1">page</a> moi@chaine.fr' END"""


def _small_web(t) -> DataFrame:
    pages = {
        "/": HOME,
        "/contact": "CASE WHEN c_custkey % 6 = 2 THEN 'moi@site.fr <a href=\"agences/contact-lyon#x\">Contact Lyon</a> <a href=\"/contact\">Contact</a>' END",
        "/mentions-legales": "CASE WHEN c_custkey % 6 = 2 THEN 'rien' END",
        "/agences/contact-lyon": "CASE WHEN c_custkey % 6 = 2 THEN 'rien' END",
        "/contact.html": "CASE WHEN c_custkey % 6 = 3 THEN 'rien' END",
        "/sitemap.xml": f"CASE WHEN c_custkey % 6 = 4 THEN '<loc>https://' || {SITE} || '/infos-pratiques</loc><loc>https://' || {SITE} || '/blog</loc>' END",
        "/infos-pratiques": "CASE WHEN c_custkey % 6 = 4 THEN 'rien' END",
    }
    chain = {f"/a{i}": f"CASE WHEN c_custkey % 6 = 5 THEN '<a href=\"/a{i - 1}\">page</a> <a href=\"/a{i + 1}\">page</a>' END" for i in range(1, 8)}
    www = t("customer").where("c_custkey % 6 = 1").select(F.expr(f"'https://www.' || {SITE} || '/'").alias("url"), F.lit("moi@site.fr").alias("html"))
    return _pages(t, **pages, **chain).union(www)


@_register("""
WITH s AS (SELECT c_custkey % 6 AS m, 's' || CAST(c_custkey AS VARCHAR) || '.fr' AS site FROM customer)
SELECT site AS site_key, stage, 'https://' || CASE WHEN s.m = 1 THEN 'www.' ELSE '' END || site || path AS url FROM s JOIN (VALUES
  (1, 0, '/'), (2, 0, '/'), (2, 1, '/contact'), (2, 1, '/mentions-legales'), (2, 1, '/equipe?'), (2, 2, '/agences/contact-lyon'), (3, 0, '/'), (3, 3, '/contact.html'), (4, 0, '/'), (4, 4, '/infos-pratiques'),
  (5, 0, '/'), (5, 5, '/a1'), (5, 6, '/a2'), (5, 7, '/a3'), (5, 8, '/a4'), (5, 9, '/a5'), (5, 10, '/a6'), (5, 11, '/a7')) v(m, stage, path) ON v.m = s.m WHERE path <> '/equipe?'""")
def crawl_visits(t):
    """Which pages of a site are read at which stage, down to the end of a chain of links."""
    sites = t("customer").select(F.expr(SITE).alias("site_key"), F.expr(f"'https://' || {SITE} || '/'").alias("url"))
    deep = t("customer").where("c_custkey % 6 = 5").select(F.expr(SITE).alias("site_key"))
    return R.visit(S.cut(sites), S.cut(_small_web(t)), deep).select("site_key", "stage", "url")


def _guessed(t):
    """Sites of one page, every other one guessed; a third of all pages names the company, a seventh is gone."""
    html = f"'Tel: <a href=\"tel:+33 1 02 03 04 ' || lpad(CAST(c_custkey % 100 AS STRING), 2, '0') || '\">a</a> contact@' || {SITE} || ', jean' || {N} || '@gmail.com, Info@autre.fr ' || CASE WHEN c_custkey % 3 = 0 THEN 'RCS ' || lpad({N}, 9, '4') || '.' ELSE '' END"
    pages = S.cut(_pages(t, **{"/": f"CASE WHEN c_custkey % 7 <> 0 THEN {html} END"}))
    sites = S.cut(t("customer").select(F.expr(SITE).alias("site_key"), F.expr(f"'https://' || {SITE} || '/'").alias("url"), F.expr("c_custkey % 2 = 1").alias("guessed")))
    guesses = t("customer").where("c_custkey % 2 = 1").select(F.col("c_custkey").cast("long").alias("business_id"), F.expr(SITE).alias("site_key"), business_tokens(F.lit(""), F.expr(f"lpad({N}, 9, '4')")).alias("tokens"))
    return R.crawl(sites, pages, S.cut(guesses))


GUESSED = "WITH s AS (SELECT c_custkey AS n, 's' || CAST(c_custkey AS VARCHAR) || '.fr' AS site, c_custkey % 7 <> 0 AS there, c_custkey % 2 = 0 OR c_custkey % 3 = 0 AS sure FROM customer)"


@_register(GUESSED + """
SELECT site AS site_key, 'email' AS what, CASE i WHEN 0 THEN 'contact@' || site WHEN 1 THEN 'jean' || CAST(n AS VARCHAR) || '@gmail.com' ELSE 'info@autre.fr' END AS value, kind || ' ' || role || ' https://' || site || '/' AS more
FROM s, (VALUES (0, 'domaine_site', 'true'), (1, 'gratuit', 'false'), (2, 'pro', 'true')) v(i, kind, role) WHERE there AND sure
UNION ALL SELECT site, 'phone', '01 02 03 04 ' || lpad(CAST(n % 100 AS VARCHAR), 2, '0'), '' FROM s WHERE there AND sure
UNION ALL SELECT site, 'status', CASE WHEN NOT there THEN 'unreachable' WHEN NOT sure THEN 'unverified' ELSE 'ok' END, CASE WHEN there THEN '1' ELSE '0' END FROM s
UNION ALL SELECT site, 'confirmed', CAST(n AS VARCHAR), 'https://' || site || '/' FROM s WHERE there AND n % 2 = 1 AND n % 3 = 0""")
def crawl_round(t):
    """Addresses by kind, telephones, what is said of the sites and which guesses are confirmed; a guessed site counts only where it proves whose it is."""
    r = _guessed(t)
    text = lambda *c: F.concat_ws(" ", *(F.col(x).cast("string") for x in c))
    rows = [
        r.emails.select("site_key", F.lit("email").alias("what"), F.col("email").alias("value"), text("kind", "is_role", "source_url").alias("more")),
        r.phones.select("site_key", F.lit("phone"), "phone", F.lit("")),
        r.sites.select("site_key", F.lit("status"), "status", text("pages")),
        r.confirmed.select("site_key", F.lit("confirmed"), text("business_id"), "url"),
    ]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


@_register("""
WITH RECURSIVE e AS (SELECT DISTINCT c_nationkey AS a, (c_nationkey * 7 + c_custkey % 2 + 1) % 25 AS b FROM customer),
r AS (SELECT CAST(0 AS INTEGER) AS site, 0 AS turn UNION SELECT CAST(e.b AS INTEGER), r.turn + 1 FROM r JOIN e ON e.a = r.site WHERE r.turn < 3)
SELECT 'garage' || CAST(site AS VARCHAR) || '.fr' AS site_key, CAST(min(turn) AS BIGINT) AS turn FROM r WHERE site <> 0 GROUP BY site""")
def partner_rounds(t):
    """Sites found within three rounds of links between garages, from one that is pending."""
    edges = t("customer").select(F.col("c_nationkey").alias("a"), ((F.col("c_nationkey") * 7 + F.col("c_custkey") % 2 + 1) % 25).alias("b")).distinct()
    link = F.expr("'<a href=\"https://garage' || CAST(b AS STRING) || '.fr/nous?x=1\">Garage partenaire</a> <a href=\"https://www.facebook.com/garage\">garage</a>'")
    pages = edges.groupBy("a").agg(F.array_join(F.sort_array(F.collect_set(link)), " ").alias("html")).select(F.expr("'https://garage' || CAST(a AS STRING) || '.fr/'").alias("url"), "html")
    spark = edges.sparkSession
    sites = spark.createDataFrame([("garage0.fr", "https://garage0.fr/", False, "pending", None, 0, 0)], table("sites"))
    found = R.rounds(sites, spark.createDataFrame([], table("businesses")), S.cut(pages), spark.createDataFrame([], table("guesses")))[4]
    return found.select("site_key", (F.col("ingest_seq") + 1).alias("turn"))


AGENT = f"'agent' || {N}"
DOMAIN = "'atelier' || CAST(c_custkey % 50 AS STRING) || '.fr'"
# One way to hide an address for each remainder; the last rows hold none.
HIDDEN = f"""CASE c_custkey % 12
  WHEN 0 THEN 'Ecrire: ' || {AGENT} || '@' || {DOMAIN} || '.'
  WHEN 1 THEN '<a href="mailto:' || {AGENT} || '%40' || {DOMAIN} || '?subject=a">x</a>'
  WHEN 2 THEN '<p>' || {AGENT} || '&#64;' || {DOMAIN} || '</p>'
  WHEN 3 THEN '<script>var a = "' || {AGENT} || '\\\\u0040' || {DOMAIN} || '"</script>'
  WHEN 4 THEN {AGENT} || ' [at] ' || replace({DOMAIN}, '.', ' [dot] ') || ' '
  WHEN 5 THEN {AGENT} || ' arobase ' || replace({DOMAIN}, '.', ' point ') || ' '
  WHEN 6 THEN '"' || {AGENT} || '" + "@" + "' || {DOMAIN} || '"'
  WHEN 7 THEN '<b data-user="' || {AGENT} || '" class="c" data-domain="' || {DOMAIN} || '"></b>'
  WHEN 8 THEN '<a href="data:text/vcard,BEGIN%3AVCARD%0AEMAIL%3A' || {AGENT} || '%40' || {DOMAIN} || '%0AEND">x</a>'
  WHEN 9 THEN '<a href="data:text/vcard;base64,' || base64(CAST('EMAIL:' || {AGENT} || '@' || {DOMAIN} || ' END:VCARD' AS BINARY)) || '">x</a>'
  WHEN 10 THEN '<img src="logo@2x.png"> @media print noreply@' || {DOMAIN} || ' ' || repeat('0a', 12) || '@' || {DOMAIN} || ' nom@example.com'
  ELSE 'mot' || chr(10) || '@' || {DOMAIN} END"""


@_register("SELECT c_custkey, 'agent' || CAST(c_custkey AS VARCHAR) || '@atelier' || CAST(c_custkey % 50 AS VARCHAR) || '.fr' AS email FROM customer WHERE c_custkey % 12 < 10")
def emails_hidden_in_pages(t):
    """The whole extractor over every way to write an address."""
    return with_emails(t("customer").select("c_custkey", F.expr(HIDDEN).alias("html"))).select("c_custkey", F.explode("emails").alias("email"))


@_register("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'https://a.fr/nos-agences/lyon' WHEN 1 THEN 'https://a.fr/x/page?q=1' ELSE 'https://a.fr/x/y/' END AS url, CASE c_custkey % 3 WHEN 0 THEN 1 ELSE 2 END AS rank FROM customer
UNION ALL SELECT c_custkey, 'https://a.fr/x/blog', CASE c_custkey % 3 WHEN 0 THEN 2 ELSE 1 END FROM customer""")
def internal_links_ranked(t):
    """Links within a site, branches before others, resolved against their page."""
    last = "CASE c_custkey % 3 WHEN 0 THEN '../nos-agences/lyon#haut' WHEN 1 THEN 'page?q=1' ELSE './y/' END"
    html = F.expr(f"'<a href=\"blog\">B</a><a href=blog>B</a><a href=\"/logo.png\">L</a><a href=\"javascript:x\">J</a><a HREF=\\'' || {last} || '\\'>D</a><a href=\"https://b.fr/\">E</a>'")
    pages = t("customer").select("c_custkey", F.lit("https://www.a.fr/x/").alias("url"), html.alias("html"))
    found = L.internal_links(L.anchors(pages, "c_custkey"))
    return found.select(F.col("page").alias("c_custkey"), F.regexp_replace("url", "www[.]", "").alias("url"), "rank")


@_register("""SELECT c_custkey, url, rank FROM customer, (VALUES ('https://a.fr/contact', 1), ('https://a.fr/mentions-legales', 2)) v(url, rank)""")
def contact_links(t):
    html = F.lit('<a href="/mentions-legales">Mentions légales</a><a href="/blog">Blog</a><a href="/contact">Contactez-nous</a><a href="/contact">ici</a><a href="https://b.fr/contact">Contact</a><a href="/contact.jpg">Contact</a>')
    found = L.discover_links(L.anchors(t("customer").select("c_custkey", F.lit("https://a.fr/").alias("url"), html.alias("html")), "c_custkey"))
    return found.select(F.col("page").alias("c_custkey"), "url", "rank")


@_register(DOMAINS + "SELECT domain AS site_key, CAST(min(s_suppkey) AS BIGINT) AS ingest_seq FROM domains WHERE length(domain) % 3 <> 0 AND s_suppkey % 4 <> 0 AND s_suppkey % 5 <> 0 GROUP BY domain")
def guesses_that_exist(t):
    """Domains that names suggest and recorded answers confirm; businesses with a site or an address are left alone."""
    rows = t("supplier").select(F.col("s_suppkey").alias("id"), F.expr(NAMES).alias("name"), F.lit("").alias("alt_name"), F.expr(TOWNS).alias("city"), F.lit("69007").alias("postal_code"), F.lit("").alias("siren"), F.expr("CASE WHEN s_suppkey % 4 = 0 THEN 's.fr' END").alias("site_key"))
    spark = rows.sparkSession
    emails = t("supplier").where("s_suppkey % 5 = 0").select(F.col("s_suppkey").alias("business_id"))
    dns = S.cut(G.candidates(rows).select("domain").distinct().select("domain", F.expr("length(domain) % 3 <> 0").alias("ok")))
    none = {n: spark.createDataFrame([], table(n)) for n in ("sites", "dns_checked", "guesses")}
    return G.guess(rows, none["sites"], emails, none["dns_checked"], dns, none["guesses"])[0].select("site_key", "ingest_seq")


@_register("""
WITH d AS (SELECT DISTINCT domain FROM {emails}), a AS (SELECT domain, length(domain) % 4 AS m FROM d)
SELECT coalesce(m.domain, a.domain) AS domain, CASE WHEN a.domain IS NULL OR m.ok IS NOT NULL THEN m.ok ELSE CASE a.m WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false END END AS ok FROM {mx} m FULL JOIN a ON a.domain = m.domain""")
def mx_after_answers(t):
    """The table of domains after a run: those due get their recorded answer, the others stay."""
    m = F.length("domain") % 4
    answers = t("emails").select("domain").distinct().where(m < 3).select(
        "domain", F.when(m == 1, "NXDOMAIN").when(m == 0, "NOERROR").otherwise("NOANSWER").alias("rcode"), F.when(m == 0, F.array(F.lit("mx.a.fr."))).alias("hosts"), F.lit(False).alias("has_address")
    )
    mx = t("mx").withColumn("ingest_seq", F.lit(0).cast("long"))
    return V.verify(t("emails"), mx, answers).select("domain", "ok")


@_register("""SELECT 'p' || CAST(c_custkey AS VARCHAR) AS source_id, CASE WHEN c_custkey % 4 = 0 THEN 'Pneus ' ELSE '' END || c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN 'pneus' ELSE 'garage' END AS category,
  lpad(CAST(c_nationkey AS VARCHAR), 5, '6') AS postal_code, 'Ville ' || CAST(c_nationkey AS VARCHAR) AS city, CASE WHEN c_custkey % 2 = 0 THEN 'https://p.fr/' ELSE '' END AS website FROM customer WHERE c_custkey % 5 <> 0""")
def places_to_business(t):
    json = F.expr(f"""'{{"id":"p' || {N} || '","displayName":{{"text":"' || CASE WHEN c_custkey % 4 = 0 THEN 'Pneus ' ELSE '' END || c_name || '"}},"addressComponents":[{{"longText":"FR","types":["country"]}},{{"longText":"'
      || lpad(CAST(c_nationkey AS STRING), 5, '6') || '","types":["postal_code"]}},{{"longText":"Ville ' || CAST(c_nationkey AS STRING) || '","types":["locality","political"]}}]' || CASE WHEN c_custkey % 2 = 0 THEN ',"websiteUri":"https://p.fr/"' ELSE '' END
      || CASE WHEN c_custkey % 5 = 0 THEN ',"businessStatus":"CLOSED_PERMANENTLY"' WHEN c_custkey % 5 = 1 THEN ',"businessStatus":"OPERATIONAL"' ELSE '' END || '}}'""")
    rows = t("customer").select(F.from_json(json, table("places")).alias("r")).select("r.*", F.lit("garage").alias("category"))
    return places.businesses(rows).select("source_id", "name", "category", "postal_code", "city", "website")


@_register("""SELECT 's' || CAST(c_custkey AS VARCHAR) || '.fr' AS source_id, left(repeat(c_name || ' ', 20), 200) AS name, 'http://www.s' || CAST(c_custkey AS VARCHAR) || '.fr/' AS website FROM customer WHERE c_custkey % 4 IN (0, 1)""")
def search_hits_to_business(t):
    url = F.expr(f"CASE c_custkey % 4 WHEN 0 THEN 'http://www.' || {SITE} || '/a/b?c' WHEN 1 THEN 'http://www.' || {SITE} WHEN 2 THEN 'https://www.facebook.com/' || {N} ELSE 'rien' END")
    hits = t("customer").select(url.alias("url"), F.expr("repeat(c_name || ' ', 20)").alias("title"), F.lit("garage").alias("category"), F.lit("Lyon").alias("city"), F.col("c_custkey").cast("long").alias("ingest_seq"))
    return search.businesses(hits).select("source_id", "name", "website")


def _list_business(t, text: bool) -> DataFrame:
    spark = t("nation").sparkSession
    rows = t("customer").select(F.expr(f"CASE WHEN c_custkey % 6 = 0 THEN '' ELSE c_name END").alias("nom"), F.expr(f"CASE WHEN c_custkey % 9 = 0 THEN '' ELSE ' ' || {SITE} || '/x ' END").alias("site web"), F.expr("'Ville ' || CAST(c_nationkey AS STRING)").alias("ville"))
    folder = _folder(spark, "list")
    if text:
        rows.select(F.expr("CASE WHEN `site web` = '' THEN '# none' ELSE `site web` END")).write.text(folder)
        return files.businesses(files.read_lines(spark, folder))
    rows.write.option("header", True).option("sep", ";").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)
    return files.businesses(files.read_csv(spark, folder))


@_register("SELECT 's' || CAST(c_custkey AS VARCHAR) || '.fr' AS source_id, CASE WHEN c_custkey % 6 = 0 THEN 's' || CAST(c_custkey AS VARCHAR) || '.fr' ELSE c_name END AS name, 'Ville ' || CAST(c_nationkey AS VARCHAR) AS city, 'https://s' || CAST(c_custkey AS VARCHAR) || '.fr/x' AS website FROM customer WHERE c_custkey % 9 <> 0")
def site_list_csv(t):
    return _list_business(t, False).select("source_id", "name", "city", "website")


@_register("SELECT 's' || CAST(c_custkey AS VARCHAR) || '.fr' AS source_id, 's' || CAST(c_custkey AS VARCHAR) || '.fr' AS name, '' AS city, 'https://s' || CAST(c_custkey AS VARCHAR) || '.fr/x' AS website FROM customer WHERE c_custkey % 9 <> 0")
def site_list_lines(t):
    return _list_business(t, True).select("source_id", "name", "city", "website")


@_register("""
WITH d AS (SELECT lpad(CAST(i AS VARCHAR), 2, '0') AS department FROM range(1, 96) r(i) WHERE i <> 20 UNION ALL SELECT unnest(['2A', '2B', '971', '972', '973', '974', '976']))
SELECT naf, category, department FROM d, (VALUES ('45.20A', 'garage'), ('45.11Z', 'concession')) v(naf, category)""")
def register_requests(t):
    """What to ask the register: every code and department once, under the first category that has the code."""
    return register.requests(t("nation").sparkSession, ["garage", "carrosserie", "concession", "garage"]).select("naf", "category", "department")


@_register("SELECT 'autre' AS category, keyword, n_name AS city, keyword || ' ' || n_name AS request FROM nation, (VALUES ('garage'), ('pneus neufs')) v(keyword)")
def query_grid(t):
    """What to ask a places service or a search engine: every keyword and town once. Towns are 25 names of nations."""
    towns = [r["n_name"] for r in t("nation").select("n_name").collect()]
    return places.requests(t("nation").sparkSession, towns + towns, keywords=["garage", "pneus neufs"])


@_register("SELECT page_id, url FROM pages WHERE page_id % 5 <> 0 AND page_id % 7 NOT IN (0, 3) AND NOT (page_id % 2 = 0 AND regexp_matches(url, '^[a-z]+://[^/?#]*/(de|fr)/'))")
def readable_pages(t):
    """Recorded pages that can be read: no errors, only text, and what robots rules of their origin allow."""
    number = F.col("page_id")
    kind = F.when(number % 7 == 3, "application/pdf").when(number % 7 == 1, None).otherwise("Text/HTML; charset=utf-8")
    url = F.expr("regexp_replace(url, '^([a-z]+://)', '$1h' || CAST(page_id % 2 AS STRING) || '.')")
    pages = t("pages").select("page_id", url.alias("url"), F.when(number % 5 == 0, 404).otherwise(200).alias("status"), kind.alias("content_type"), F.when(number % 7 != 0, F.col("html")).alias("html"), F.col("url").alias("own"))
    origins = pages.where(F.col("page_id") % 2 == 0).select(F.expr("regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)").alias("origin")).distinct()
    robots = origins.select("origin", F.lit(200).alias("status"), F.lit("User-agent: *\nDisallow: /de/\nDisallow: /fr/\n").alias("body"))
    return R.permitted(pages, robots).select("page_id", F.col("own").alias("url"))


@_register("SELECT site_key, CASE WHEN p.k IS NULL THEN status ELSE 'ok' END AS status, CASE WHEN p.k IS NULL THEN 0 ELSE 3 END AS pages FROM {sites} LEFT JOIN (SELECT DISTINCT 's' || CAST(c_custkey % 300 AS VARCHAR) || '.fr' AS k FROM customer) p ON p.k = site_key")
def sites_saved(t):
    sites = t("sites").select("site_key", "status", F.lit(None).cast("string").alias("final_url"), F.lit(0).cast("long").alias("pages"))
    read = t("customer").select(F.expr("'s' || CAST(c_custkey % 300 AS STRING) || '.fr'").alias("site_key")).distinct()
    return S.save_sites(sites, read.select("site_key", F.lit("ok").alias("status"), F.lit("https://x.fr/").alias("final_url"), F.lit(3).cast("long").alias("pages"))).select("site_key", "status", F.col("pages").cast("int").alias("pages"))


@_register("""
WITH g AS (SELECT business_id, min(site_key) AS k FROM {guesses} WHERE verified GROUP BY business_id)
SELECT id, coalesce(b.site_key, g.k) AS site_key FROM {businesses} b LEFT JOIN g ON g.business_id = b.id""")
def guessed_sites_linked(t):
    """Businesses without a site get that of their first confirmed guess."""
    confirmed = t("guesses").where("verified").withColumn("url", F.concat(F.lit("https://"), "site_key", F.lit("/")))
    return S.link_guessed(t("businesses"), confirmed).select("id", "site_key")


@_register("SELECT email, site_key, business_id FROM {emails} WHERE domain <> 's3.fr' AND email <> 'contact@gmail.com'")
def emails_not_opted_out(t):
    spark = t("nation").sparkSession
    return S.suppress(t("emails"), spark.createDataFrame([(" S3.fr ",), ("Contact@gmail.com",)], "value string")).select("email", "site_key", "business_id")


def _two_batches(t) -> list[DataFrame]:
    a = t("customer").select(F.lit("osm").alias("source"), F.expr("'k' || CAST(c_custkey % 700 AS STRING)").alias("source_id"), F.col("c_name").alias("name"), F.expr(f"CASE WHEN c_custkey % 2 = 0 THEN {SITE} END").alias("website"), F.expr(f"array('Contact@' || {SITE})").alias("emails"), F.col("c_custkey").cast("long").alias("ingest_seq"))
    return [a, a.withColumn("name", F.lit("again")).withColumn("source_id", F.expr("CASE WHEN ingest_seq % 3 = 0 THEN source_id ELSE 'n' || source_id END"))]


BATCHES = """
WITH every AS (
  SELECT 'k' || CAST(c_custkey % 700 AS VARCHAR) AS source_id, c_name AS name, c_custkey AS n, 1 AS batch FROM customer
  UNION ALL SELECT CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'n' END || 'k' || CAST(c_custkey % 700 AS VARCHAR), 'again', c_custkey, 2 FROM customer),
first AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY batch, n) AS turn FROM every),
kept AS (SELECT *, CASE WHEN n % 2 = 0 THEN 's' || CAST(n AS VARCHAR) || '.fr' END AS site_key, row_number() OVER (ORDER BY batch, n, source_id) AS id FROM first WHERE turn = 1)
"""


def _collected(t) -> Directory:
    spark = t("nation").sparkSession
    d = Directory(spark, _folder(spark, "directory"))
    for batch in _two_batches(t):
        d.collect(batch)
    return d


@_register(BATCHES + "SELECT source_id, name, site_key, id FROM kept")
def directory_businesses(t):
    """The stored table after two batches; the first row of a key wins, also against a later batch."""
    return _collected(t).businesses.select("source_id", "name", "site_key", "id")


@_register(BATCHES + "SELECT site_key, 'https://' || site_key || '/' AS url, 'pending' AS status, min(id) AS ingest_seq FROM kept WHERE site_key IS NOT NULL GROUP BY site_key")
def directory_sites(t):
    return _collected(t).sites.select("site_key", "url", "status", "ingest_seq")


@_register(BATCHES + "SELECT 'contact@s' || CAST(n AS VARCHAR) || '.fr' AS email, id AS business_id, CASE WHEN n % 2 = 0 THEN 'domaine_site' ELSE 'pro' END AS kind FROM kept")
def directory_emails(t):
    return _collected(t).emails.select("email", "business_id", "kind")


@_register("SELECT email, min(business_id) AS business_id FROM {emails} GROUP BY email")
def export_written_and_read(t):
    """Rows written as CSV files with a header for each, and read again."""
    rows = t("emails").groupBy("email").agg(F.min("business_id").alias("business_id")).orderBy("email")
    folder = _folder(rows.sparkSession, "csv")
    X.write_csv_parts(rows, folder)
    return rows.sparkSession.read.schema(rows.schema).option("header", True).option("sep", ";").csv(folder)
