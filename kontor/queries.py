"""The registered queries of the engine, each with the SQL that says the same.

The synthetic tables hold few addresses and no businesses, so several queries read tables derived from them. What
derives them is SQL that both engines understand; a query and its SQL begin from the same text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kontor.functions import email as E
from kontor.functions import links as L
from kontor.functions import names as N
from kontor.functions import phone as P
from kontor.functions import text as T
from kontor.functions import url as U
from kontor.operators import state as S
from kontor.plans import collect as C
from kontor.plans import export as X
from kontor.plans import verify as V
from kontor.policy import DEFAULT, FIXTURE, KIND_RANK
from kontor.sources import maps, register

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# Tables derived from the synthetic ones; read by both engines.
DERIVED = {
    "businesses": """
SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'sirene' ELSE 'osm' END AS source, 'c/' || CAST(c_custkey AS STRING) AS source_id,
  CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 13 = 0 THEN NULL ELSE c_name END AS name, c_mktsegment AS category,
  'rue ' || CAST(c_custkey % 97 AS STRING) AS address, lpad(CAST(c_custkey % 95000 + 1000 AS STRING), 5, '0') AS postal_code,
  'ville ' || CAST(c_nationkey AS STRING) AS city,
  CASE WHEN c_custkey % 5 = 0 THEN '01 02 03 04 ' || lpad(CAST(c_custkey % 100 AS STRING), 2, '0') ELSE '' END AS phone,
  CASE WHEN c_custkey % 3 = 0 THEN 'https://s' || CAST(c_custkey % 400 AS STRING) || '.fr/' ELSE '' END AS website,
  CASE WHEN c_custkey % 3 = 0 THEN 's' || CAST(c_custkey % 400 AS STRING) || '.fr' END AS site_key,
  lpad(CAST(c_custkey AS STRING), 9, '7') AS siren, '45.20A' AS naf FROM {customer}""",
    "emails": """
SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'contact' ELSE 'agent' || CAST(s_suppkey % 23 AS STRING) END || '@' || CASE WHEN s_suppkey % 4 = 0 THEN 'gmail.com' ELSE 's' || CAST(s_suppkey % 40 AS STRING) || '.fr' END AS email,
  CASE WHEN s_suppkey % 4 = 0 THEN 'gmail.com' ELSE 's' || CAST(s_suppkey % 40 AS STRING) || '.fr' END AS domain,
  CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 's' || CAST(s_suppkey * 7 % 450 AS STRING) || '.fr' END AS site_key,
  CAST(CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey * 3 ELSE 0 END AS BIGINT) AS business_id,
  CASE WHEN s_suppkey % 4 = 0 THEN 'gratuit' WHEN s_suppkey % 2 = 0 THEN 'pro' ELSE 'domaine_site' END AS kind,
  s_suppkey % 3 = 0 AS is_role, 'https://s' || CAST(s_suppkey % 40 AS STRING) || '.fr/p' || CAST(s_suppkey AS STRING) AS source_url, s_suppkey AS ingest_seq FROM {supplier}""",
    "guesses": """
SELECT CAST(c_custkey + 1 AS BIGINT) AS business_id, 's' || CAST(400 + c_custkey % 50 AS STRING) || '.fr' AS site_key, c_custkey % 2 = 0 AS verified FROM {customer}""",
    "mx": """
SELECT 's' || CAST(s_suppkey AS STRING) || '.fr' AS domain, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey % 3 = 1 END AS ok FROM {supplier}""",
    "phones": """
SELECT 's' || CAST(c_custkey % 450 AS STRING) || '.fr' AS site_key, '02 00 00 ' || lpad(CAST(c_custkey % 60 AS STRING), 2, '0') || ' 0' || CAST(c_nationkey % 10 AS STRING) AS phone FROM {customer}""",
    "sites": """
SELECT 's' || CAST(p_partkey % 500 AS STRING) || '.fr' AS site_key, CASE WHEN min(p_partkey) % 4 = 0 THEN 'ok' WHEN min(p_partkey) % 4 = 1 THEN 'pending' WHEN min(p_partkey) % 4 = 2 THEN 'unreachable' ELSE 'unverified' END AS status,
  min(p_partkey) % 7 = 0 AS guessed, min(p_partkey) AS ingest_seq FROM {part} GROUP BY p_partkey % 500""",
}
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


def _sql(text: str) -> str:
    """SQL for the other engine: names of derived tables become sub-selects."""
    for name, sql in DERIVED.items():
        text = text.replace("{" + name + "}", "(" + sql.strip() + ")")
    for name in TABLES:
        text = text.replace("{" + name + "}", name)
    return text


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the synthetic tables, or one derived from them."""
    if name in DERIVED:
        used = [t for t in TABLES if "{" + t + "}" in DERIVED[name]]
        return spark.sql(DERIVED[name], **{t: read(spark, sf_dir, t) for t in used})
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _register(sql: str | None = None):
    """Registers a function of (table reader) as a query under its name."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: read(spark, sf_dir, name))
        if sql is not None:
            ORACLE_SQL[f.__name__] = _sql(sql)
        return f

    return add


def _list(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


# SQL of address scanning and cleaning: parts around each at-sign, then the rules one by one.
SCAN = r"""
parts AS (SELECT id, string_split(text, '@') AS p FROM source),
around AS (SELECT id, p[i] AS l, p[i + 1] AS r FROM (SELECT id, p, unnest(generate_series(1, len(p) - 1)) AS i FROM parts)),
candidates AS (
  SELECT id, regexp_extract(right(regexp_replace(right(l, 65), ' $', ''), 64), '[a-zA-Z0-9._%+-]{1,64}$') AS lo,
    regexp_extract(r, '^ ?((?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,24})(?:[^a-zA-Z0-9-]|$)', 1) AS d FROM around),
"""
CLEAN = r"""
trimmed AS (SELECT id, regexp_replace(lower(lo), '^[._%+-]+|[._%+-]+$', '', 'g') AS lo, regexp_replace(lower(d), '^[.-]+|[.-]+$', '', 'g') AS d FROM candidates WHERE lo <> '' AND d <> ''),
cleaned AS (
  SELECT DISTINCT id, lo || '@' || d AS email, d AS domain, lo AS local FROM trimmed
  WHERE regexp_full_match(lo, '[a-z0-9._%+-]{1,64}') AND regexp_full_match(d, '[a-z0-9.-]*\.[a-z]{2,}') AND NOT contains(lo, '..') AND NOT contains(d, '..')
    AND string_split(d, '.')[-1] NOT IN """ + _list(FIXTURE.bad_tlds) + r"""
    AND NOT regexp_matches(d, '""" + FIXTURE.placeholder_domain + r"""')
    AND len(list_filter(""" + "[" + _list(FIXTURE.bad_domains)[1:-1] + "]" + r""", lambda b: d = b OR ends_with(d, '.' || b))) = 0
    AND lo NOT IN """ + _list(FIXTURE.bad_locals) + r""" AND NOT regexp_matches(lo, '""" + FIXTURE.bad_local + r"""') AND NOT regexp_full_match(lo, '[0-9a-f]{20,}'))
"""
KIND = "CASE WHEN domain IN " + _list(FIXTURE.free_domains) + " THEN 'gratuit' ELSE 'pro' END"
ROLE = "string_split(local, '+')[1] IN " + _list(FIXTURE.role_locals)


def _documents_and_pages(t) -> DataFrame:
    """(id, text): documents, then pages under negative ids."""
    return t("documents").select(F.col("doc_id").alias("id"), "text").union(t("pages").select((-1 - F.col("page_id")).alias("id"), F.col("html").alias("text")))


BOTH = "source AS (SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL UNION ALL SELECT -1 - page_id, html FROM pages WHERE html IS NOT NULL),"


def _scanned(rows: DataFrame, policy=FIXTURE) -> DataFrame:
    # Only rows with an at-sign are looked at more closely.
    return rows.where(F.col("text").contains("@")).select("id", F.explode(E._cleaned(E.at_signs(F.col("text")), policy)).alias("email"))


@_register("WITH source AS (SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL)," + SCAN + CLEAN + "SELECT id AS doc_id, email FROM cleaned")
def emails_scan_documents(t):
    return _scanned(t("documents").select(F.col("doc_id").alias("id"), "text")).select(F.col("id").alias("doc_id"), "email")


@_register("WITH source AS (SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL)," + SCAN + CLEAN + "SELECT count(*) AS with_fixture, CAST(count(CASE WHEN NOT regexp_matches(domain, '(^|\\.)example\\.(com|fr|org)$') THEN 1 END) AS BIGINT) AS with_default FROM cleaned")
def emails_default_policy(t):
    rows = t("documents").select(F.col("doc_id").alias("id"), "text")
    a, b = (_scanned(rows, p).agg(F.count("*").alias(n)) for p, n in ((FIXTURE, "with_fixture"), (DEFAULT, "with_default")))
    return a.join(F.broadcast(b))  # one row each


@_register("WITH " + BOTH + SCAN + CLEAN + f"SELECT id, email, domain, {KIND} AS kind, {ROLE} AS is_role FROM cleaned")
def email_kind_role(t):
    e = F.col("email")
    none = F.array().cast("array<string>")
    return _scanned(_documents_and_pages(t)).select("id", "email", E.domain_of(e).alias("domain"), E.email_kind(e, none, FIXTURE).alias("kind"), E.is_role(e, FIXTURE).alias("is_role"))


@_register("WITH " + BOTH + SCAN + CLEAN + f", ranked AS (SELECT *, {KIND} AS kind, row_number() OVER (PARTITION BY email ORDER BY CASE {KIND} WHEN 'domaine_site' THEN 0 WHEN 'pro' THEN 1 ELSE 2 END, id < 0, abs(id)) AS n FROM cleaned) SELECT email, kind, id AS first_seen FROM ranked WHERE n = 1")
def best_row_per_email(t):
    rows = _scanned(_documents_and_pages(t)).withColumn("kind", E.email_kind(F.col("email"), F.array().cast("array<string>"), FIXTURE))
    best = S.first_of_each(rows, ["email"], E.kind_rank(F.col("kind")), F.col("id") < 0, F.abs("id"))
    return best.select("email", "kind", F.col("id").alias("first_seen")).orderBy("email")


@_register("WITH " + BOTH + SCAN + CLEAN + f"SELECT {KIND} AS kind, count(DISTINCT email) AS n FROM cleaned GROUP BY 1")
def distinct_emails_by_kind(t):
    kind = E.email_kind(F.col("email"), F.array().cast("array<string>"), FIXTURE)
    return _scanned(_documents_and_pages(t)).groupBy(kind.alias("kind")).agg(F.countDistinct("email").alias("n"))


HOST = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '\\.+$', '')"
PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
REGISTRABLE = "CASE WHEN len(string_split(h, '.')) <= 2 THEN h WHEN length(string_split(h, '.')[-1]) = 2 AND string_split(h, '.')[-2] IN " + _list(DEFAULT.second_level) + " THEN array_to_string(string_split(h, '.')[-3:], '.') ELSE array_to_string(string_split(h, '.')[-2:], '.') END"


@_register(f"SELECT page_id, regexp_replace({HOST}, '^www\\.', '') AS site_key, regexp_extract(url, '^[a-z]+://[^/?#]*') || CASE {PATH} WHEN '' THEN '/' ELSE {PATH} END AS start_url FROM pages")
def site_key_from_url(t):
    return t("pages").select("page_id", U.site_from_url(F.col("url")).alias("s")).select("page_id", F.col("s.site_key").alias("site_key"), F.col("s.url").alias("start_url"))


@_register(f"SELECT page_id, {REGISTRABLE} AS domain FROM (SELECT page_id, regexp_replace({HOST}, '^www\\.', '') AS h FROM pages)")
def registrable_domain(t):
    return t("pages").select("page_id", U.registrable(U.host_of(F.col("url"))).alias("domain"))


@_register(f"SELECT identity, min(page_id) AS page_id FROM (SELECT page_id, regexp_replace({HOST}, '^www\\.', '') || regexp_replace({PATH}, '/+$', '') || '?' || regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS identity FROM pages) GROUP BY identity")
def page_identity_dedupe(t):
    rows = t("pages").select("page_id", U.page_identity(F.col("url")).alias("identity"))
    return S.first_of_each(rows, ["identity"], "page_id").select("identity", "page_id")


@_register(f"SELECT site_key, count(*) AS n FROM (SELECT regexp_replace({HOST}, '^www\\.', '') AS site_key FROM pages) GROUP BY site_key HAVING count(*) >= 3")
def network_sites(t):
    return S.network_sites(t("pages").select(U.site_from_url(F.col("url"))["site_key"].alias("site_key")))


@_register("SELECT site_key, status, guessed, ingest_seq FROM {sites} WHERE status = 'pending' ORDER BY guessed, ingest_seq LIMIT 25")
def pending_sites_topn(t):
    return S.pending(t("sites"), 25).select("site_key", "status", "guessed", "ingest_seq")


@_register()
def internal_links_top(t):
    """Oracle: none; links are found by look-ahead. Tests hold it against the standard library's parser."""
    return L.internal_links(L.anchors(t("pages"), limit=L.MAX_INTERNAL_ANCHORS)).select(F.col("page").alias("page_id"), "url", "rank")




@_register("""
SELECT page_id, shown, CASE WHEN regexp_matches(lower(shown), '\\.vcf|vcard|enregistrer le contact|carte de visite') THEN 11 WHEN regexp_matches(lower(shown), 'contact|joindre|[ée]crire') THEN 10
  WHEN regexp_matches(lower(shown), 'mentions|l[ée]gal|impressum|imprint') THEN 9 WHEN regexp_matches(lower(shown), 'coordonn|infos?[- ]pratiques|nous[- ]trouver|horaires') THEN 6
  WHEN regexp_matches(lower(shown), 'about|[ée]quipe|team') THEN 5 WHEN regexp_matches(lower(shown), 'devis|rendez|r[ée]servation') THEN 4 ELSE 0 END AS score
FROM (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'Nous CONTACTER' WHEN 1 THEN 'Mentions LÉGALES' WHEN 2 THEN 'nos horaires' WHEN 3 THEN 'notre ÉQUIPE' WHEN 4 THEN 'demande de devis' ELSE 'accueil' END AS shown FROM pages)""")
def contact_link_scores(t):
    shown = F.expr("CASE page_id % 6 WHEN 0 THEN 'Nous CONTACTER' WHEN 1 THEN 'Mentions LÉGALES' WHEN 2 THEN 'nos horaires' WHEN 3 THEN 'notre ÉQUIPE' WHEN 4 THEN 'demande de devis' ELSE 'accueil' END")
    return t("pages").select("page_id", shown.alias("shown")).withColumn("score", L.contact_score(F.col("shown")))


HIDDEN = "'écrire à ' || lower(replace(s_name, '#', '-')) || CASE s_suppkey % 3 WHEN 0 THEN ' [at] ' WHEN 1 THEN '(at)' ELSE ' arobase ' END || 'garage' || CAST(s_suppkey AS STRING) || CASE s_suppkey % 2 WHEN 0 THEN ' [dot] ' ELSE ' point ' END || 'fr , merci'"


@_register("SELECT s_suppkey, regexp_replace(lower(replace(s_name, '#', '-')), '^[._%+-]+', '') || '@garage' || CAST(s_suppkey AS VARCHAR) || '.fr' AS email FROM supplier")
def deobfuscate_at_dot(t):
    return t("supplier").select("s_suppkey", F.explode(E.plain_emails(F.expr(HIDDEN))).alias("email"))


@_register("SELECT c_custkey, lower(replace(c_name, '#', '.')) || '@c' || CAST(c_custkey AS VARCHAR) || '.fr' AS email FROM customer")
def protected_decode(t):
    """Customers' addresses, hidden by XOR in the query and decoded again."""
    plain = F.expr("lower(replace(c_name, '#', '.')) || '@c' || CAST(c_custkey AS STRING) || '.fr'")
    key = (F.col("c_custkey") % 251 + 1).cast("int")
    codes = F.transform(F.sequence(F.lit(1), F.length("plain")), lambda i: F.lpad(F.hex(F.ascii(F.substring(F.col("plain"), i, F.lit(1))).bitwiseXOR(F.col("key"))), 2, "0"))
    hidden = F.concat(F.lpad(F.hex("key"), 2, "0"), F.array_join(codes, ""))
    return t("customer").select("c_custkey", plain.alias("plain"), key.alias("key")).select("c_custkey", E.protected_decode(hidden).alias("email"))


@_register("SELECT c_custkey, lower(replace(c_name, '#', '+')) || '@garage' || CAST(c_nationkey AS VARCHAR) || '.fr' AS email FROM customer UNION ALL SELECT c_custkey, 'deux' || CAST(c_custkey AS VARCHAR) || '@garage.fr' FROM customer")
def mailto_targets(t):
    html = F.expr("""'<a href="mailto:' || lower(replace(c_name, '#', '+')) || '%40garage' || CAST(c_nationkey AS STRING) || '.fr,deux' || CAST(c_custkey AS STRING) || '%40garage.fr?subject=x">x</a>'""")
    return E.with_emails(t("customer").select("c_custkey", html.alias("html"))).select("c_custkey", F.explode("emails").alias("email"))


NUMBERS = "CASE c_custkey % 4 WHEN 0 THEN '+33 ' WHEN 1 THEN '0033' WHEN 2 THEN '0' ELSE '9' END || CAST(c_nationkey % 10 AS STRING) || '.' || lpad(CAST(c_custkey % 100000000 AS STRING), 8, '1')"


@_register(f"""SELECT c_custkey, CASE WHEN regexp_full_match(n, '0[1-9][0-9]{{8}}') THEN n[1:2] || ' ' || n[3:4] || ' ' || n[5:6] || ' ' || n[7:8] || ' ' || n[9:10] END AS phone
FROM (SELECT c_custkey, regexp_replace(regexp_replace({NUMBERS}, '[^0-9+]', '', 'g'), '^(\\+33|0033)', '0') AS n FROM customer)""")
def phone_normalise(t):
    return t("customer").select("c_custkey", P.normalised(F.expr(NUMBERS)).alias("phone"))


@_register("""SELECT s_suppkey, '04 ' || substr(d, 1, 2) || ' ' || substr(d, 3, 2) || ' ' || substr(d, 5, 2) || ' ' || substr(d, 7, 2) AS phone FROM (SELECT s_suppkey, lpad(CAST(s_suppkey AS VARCHAR), 8, '2') AS d FROM supplier)""")
def phone_extract(t):
    d = "lpad(CAST(s_suppkey AS STRING), 8, '2')"
    text = F.expr(f"'Tel. +33 4' || {d} || ' ou 12345' || {d} || '9, siret 7' || {d} || '00012 fin'")
    return t("supplier").select("s_suppkey", F.explode(P.extract_phones(text)).alias("phone"))


NAMES = "CASE s_suppkey % 4 WHEN 0 THEN 'SARL Garage ' WHEN 1 THEN 'Carrosserie & ' WHEN 2 THEN 'Auto Service ' ELSE 'Société Générale ' END || CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 'Dupré' || CAST(s_suppkey AS STRING) END"
TOWNS = "CASE WHEN s_nationkey % 3 = 0 THEN '' ELSE 'Lyon ' || CAST(s_nationkey AS STRING) END"
SPLIT = "list_filter(regexp_extract_all(replace(lower(strip_accents({0})), '&', ' et '), '[a-z0-9]+'), lambda w: w NOT IN " + _list(DEFAULT.legal_forms) + ")"
DOMAINS = f"""
WITH w AS (SELECT s_suppkey, {SPLIT.format(NAMES)} AS n, {SPLIT.format(TOWNS)}[1:3] AS c FROM supplier),
k AS (SELECT *, list_filter(n, lambda x: x NOT IN {_list(DEFAULT.generic_words)}) AS core FROM w),
ok AS (SELECT *, len(core) < len(n) AND length(array_to_string(core, '')) >= 5 AS short, len(c) > 0 AND n[-len(c):] <> c AS town FROM k WHERE len(n) BETWEEN 1 AND 5 AND len(core) > 0),
lists AS (
  SELECT s_suppkey, n AS ws, true AS main FROM ok UNION ALL SELECT s_suppkey, n || c, false FROM ok WHERE town UNION ALL SELECT s_suppkey, core, false FROM ok WHERE short
  UNION ALL SELECT s_suppkey, core || ['auto'], false FROM ok WHERE short UNION ALL SELECT s_suppkey, ['garage'] || core, false FROM ok WHERE short AND n[1] <> 'garage'),
bases AS (SELECT s_suppkey, main, array_to_string(ws, '') AS b FROM lists UNION ALL SELECT s_suppkey, main, array_to_string(ws, '-') FROM lists),
domains AS (
  SELECT DISTINCT s_suppkey, b || '.' || t AS domain FROM bases, (VALUES ('fr'), ('com')) v(t) WHERE length(b) BETWEEN 4 AND 63
  UNION SELECT s_suppkey, b || '.net' FROM bases WHERE main AND length(b) BETWEEN 4 AND 63)
"""


def _domains(t) -> DataFrame:
    rows = t("supplier").select("s_suppkey", N.words(F.expr(NAMES)).alias("n"), N.words(F.expr(TOWNS)).alias("c"))
    return rows.select("s_suppkey", F.explode(N.candidate_domains(F.col("n"), F.col("c"))).alias("domain"))


@_register(DOMAINS + "SELECT s_suppkey, domain FROM domains")
def candidate_domains(t):
    return _domains(t)


@_register(DOMAINS + "SELECT s_suppkey, domain FROM domains WHERE domain NOT IN (SELECT 'garagedupre' || CAST(p_partkey AS VARCHAR) || '.fr' FROM part)")
def candidates_not_known(t):
    known = t("part").select(F.expr("'garagedupre' || CAST(p_partkey AS STRING) || '.fr'").alias("domain"))
    return _domains(t).join(known, "domain", "left_anti").select("s_suppkey", "domain")


@_register("""SELECT c_custkey, c_custkey % 4 IN (0, 1) AS verified FROM customer""")
def verify_tokens_match(t):
    n = "lpad(CAST(c_custkey AS STRING), 9, '4')"
    text = F.expr(f"CASE c_custkey % 4 WHEN 0 THEN 'siren ' || substr({n}, 1, 3) || ' ' || substr({n}, 4, 3) || '.' || substr({n}, 7, 3) || ' x' WHEN 1 THEN 'F-69007 Lyon' WHEN 2 THEN 'ref 169007' ELSE 'n' || {n} || '7' END")
    tokens = N.business_tokens(F.lit("69007"), F.expr(n))
    return t("customer").select("c_custkey", N.verify_tokens(text, tokens).alias("verified"))


PARTS = "CASE p_partkey % 7 WHEN 0 THEN 'Carrosserie ' WHEN 1 THEN 'Pneus ' WHEN 2 THEN 'ÉPNEU ' WHEN 3 THEN 'CONTRÔLE technique ' WHEN 4 THEN 'Motos ' WHEN 5 THEN 'Lavage ' ELSE 'Garage ' END || p_name"


@_register("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'concession' ELSE CASE p_partkey % 7 WHEN 0 THEN 'carrosserie' WHEN 1 THEN 'pneus' WHEN 3 THEN 'controle_technique' WHEN 4 THEN 'moto' WHEN 5 THEN 'lavage' ELSE 'garage' END END AS category FROM part")
def refine_category(t):
    category = F.expr("CASE WHEN p_partkey % 3 = 0 THEN 'concession' ELSE 'garage' END")
    return t("part").select("p_partkey", N.refine_category(category, F.expr(PARTS)).alias("category"))


@_register("""
WITH every AS (
  SELECT 'osm' AS source, 'k' || CAST(c_custkey % 700 AS VARCHAR) AS source_id, c_name AS name, c_custkey AS seq, 1 AS place FROM customer
  UNION ALL SELECT 'sirene', 'k' || CAST(s_suppkey % 70 AS VARCHAR), s_name, s_suppkey, 2 FROM supplier),
first AS (SELECT *, row_number() OVER (PARTITION BY source, source_id ORDER BY seq) AS n FROM every)
SELECT source, source_id, name, row_number() OVER (ORDER BY place, seq, source_id) AS id FROM first WHERE n = 1""")
def businesses_union_keep_first(t):
    a = t("customer").select(F.lit("osm").alias("source"), F.expr("'k' || CAST(c_custkey % 700 AS STRING)").alias("source_id"), F.col("c_name").alias("name"), F.col("c_custkey").alias("ingest_seq"))
    b = t("supplier").select(F.lit("sirene").alias("source"), F.expr("'k' || CAST(s_suppkey % 70 AS STRING)").alias("source_id"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("ingest_seq"))
    none = C.canonical(C.union_sources([a.limit(0)])).withColumn("id", F.lit(0).cast("long"))
    return C.collect(none, [a, b]).select("source", "source_id", "name", "id")


@_register("SELECT id FROM {businesses} b WHERE site_key IS NULL AND NOT EXISTS (SELECT 1 FROM {emails} e WHERE e.business_id = b.id)")
def businesses_without_email(t):
    from kontor.plans.guess import to_guess

    return to_guess(t("businesses"), t("emails")).select("id")


@_register("SELECT site_key FROM {sites} WHERE status = 'ok' AND site_key NOT IN (SELECT site_key FROM {emails} WHERE site_key <> '')")
def sites_without_email(t):
    return S.without_email(t("sites"), t("emails")).select("site_key")


@_register("SELECT site_key, CASE WHEN status IN ('unreachable', 'timeout', 'error') THEN 'pending' WHEN status = 'ok' AND site_key NOT IN (SELECT site_key FROM {emails} WHERE site_key <> '') THEN 'pending' ELSE status END AS status FROM {sites}")
def reset_sites(t):
    return S.reset_without_email(S.reset_failed(t("sites")), t("emails")).select("site_key", "status")


@_register("SELECT DISTINCT e.domain FROM {emails} e LEFT JOIN {mx} m ON m.domain = e.domain WHERE m.domain IS NULL OR m.ok IS NULL")
def domains_to_check(t):
    return V.domains_to_check(t("emails"), t("mx"))


@_register("""
SELECT count(*) FILTER (WHERE ok) AS n_ok, count(*) FILTER (WHERE NOT ok) AS n_ko, count(*) FILTER (WHERE ok IS NULL) AS n_unknown
FROM (SELECT CASE c_custkey % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false WHEN 3 THEN true WHEN 4 THEN false ELSE NULL END AS ok FROM customer)""")
def mx_tristate_counts(t):
    row = t("customer").select(
        F.expr("CASE c_custkey % 6 WHEN 0 THEN 'NOERROR' WHEN 1 THEN 'NOERROR' WHEN 2 THEN 'NXDOMAIN' WHEN 3 THEN 'NOANSWER' WHEN 4 THEN 'NOANSWER' ELSE 'TIMEOUT' END").alias("rcode"),
        F.expr("CASE c_custkey % 6 WHEN 0 THEN array('mx1.x.fr.') WHEN 1 THEN array('.') ELSE array() END").cast("array<string>").alias("hosts"),
        (F.col("c_custkey") % 6 == 3).alias("has_address"),
    )
    ok = row.select(V.mx_status(F.col("rcode"), F.col("hosts"), F.col("has_address")).alias("ok"))
    return ok.agg(F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_ko"), F.count_if(F.col("ok").isNull()).alias("n_unknown"))


RANK = "CASE kind " + " ".join(f"WHEN '{k}' THEN {r}" for k, r in KIND_RANK.items()) + " ELSE 9 END"
BY_SITE = """
by_site AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY how, id) AS turn FROM (
    SELECT site_key AS key, b.*, 0 AS how FROM {businesses} b WHERE site_key <> '' UNION ALL
    SELECT g.site_key, b.*, 1 FROM {guesses} g JOIN {businesses} b ON b.id = g.business_id WHERE g.verified)) WHERE turn = 1),
phones AS (SELECT site_key, array_to_string(list_sort(list(DISTINCT phone))[1:3], ' / ') AS phones FROM {phones} GROUP BY site_key)
"""
LEADS = "WITH " + BY_SITE + f""", rows AS (
  SELECT e.*, m.ok, p.phones, CASE WHEN e.business_id <> 0 THEN i.id ELSE s.id END AS bid, CASE WHEN e.business_id <> 0 THEN i.name ELSE s.name END AS name, CASE WHEN e.business_id <> 0 THEN i.category ELSE s.category END AS category,
    CASE WHEN e.business_id <> 0 THEN i.address ELSE s.address END AS address, CASE WHEN e.business_id <> 0 THEN i.postal_code ELSE s.postal_code END AS postal_code, CASE WHEN e.business_id <> 0 THEN i.city ELSE s.city END AS city,
    CASE WHEN e.business_id <> 0 THEN i.phone ELSE s.phone END AS phone, CASE WHEN e.business_id <> 0 THEN i.website ELSE s.website END AS website, CASE WHEN e.business_id <> 0 THEN i.siren ELSE s.siren END AS siren,
    CASE WHEN e.business_id <> 0 THEN i.naf ELSE s.naf END AS naf, CASE WHEN e.business_id <> 0 THEN i.source ELSE s.source END AS source
  FROM {{emails}} e LEFT JOIN {{businesses}} i ON i.id = e.business_id LEFT JOIN by_site s ON s.key = e.site_key LEFT JOIN {{mx}} m ON m.domain = e.domain LEFT JOIN phones p ON p.site_key = e.site_key WHERE %s),
ranked AS (SELECT *, row_number() OVER (PARTITION BY email ORDER BY {RANK}, bid IS NULL OR coalesce(name = '', false), ingest_seq) AS turn FROM rows)
SELECT email, kind AS type_email, CASE WHEN is_role THEN 'oui' ELSE 'non' END AS generique, CASE WHEN ok THEN 'ok' WHEN NOT ok THEN 'invalide' ELSE 'non vérifié' END AS mx,
  coalesce(name, '') AS entreprise, coalesce(category, '') AS categorie, coalesce(address, '') AS adresse, coalesce(postal_code, '') AS code_postal, coalesce(city, '') AS ville, coalesce(phone, '') AS telephone,
  coalesce(phones, '') AS telephone_site, coalesce(nullif(website, ''), CASE WHEN site_key <> '' THEN 'https://' || site_key || '/' ELSE '' END) AS site_web, coalesce(siren, '') AS siren, coalesce(naf, '') AS naf, coalesce(source, '') AS source, source_url AS page_source
FROM ranked WHERE turn = 1"""


@_register(LEADS % "true")
def export_leads(t):
    return X.leads(*(t(n) for n in ("emails", "businesses", "guesses", "mx", "phones")))


@_register(LEADS % "e.kind <> 'gratuit' AND m.ok AND (CASE WHEN e.business_id <> 0 THEN i.category ELSE s.category END) IN ('BUILDING', 'MACHINERY')")
def export_leads_filtered(t):
    return X.leads(*(t(n) for n in ("emails", "businesses", "guesses", "mx", "phones")), pro_only=True, mx_only=True, categories=["BUILDING", "MACHINERY"])


@_register("""
WITH confirmed AS (SELECT business_id, min(site_key) AS guess FROM {guesses} WHERE verified GROUP BY business_id),
phones AS (SELECT site_key, array_to_string(list_sort(list(DISTINCT phone))[1:3], ' / ') AS phones FROM {phones} GROUP BY site_key),
rows AS (SELECT b.*, coalesce(b.site_key, c.guess, '') AS key FROM {businesses} b LEFT JOIN confirmed c ON c.business_id = b.id),
kept AS (SELECT r.*, p.phones, r.key <> '' AND r.phone = '' AS chain FROM rows r LEFT JOIN phones p ON p.site_key = r.key WHERE r.phone <> '' OR p.phones IS NOT NULL),
turns AS (SELECT *, row_number() OVER (PARTITION BY key, chain ORDER BY id) AS turn FROM kept),
found AS (SELECT t.id, 0 AS side, e.ingest_seq, e.email FROM turns t JOIN {emails} e ON e.business_id = t.id WHERE e.business_id <> 0 UNION ALL SELECT t.id, 1, e.ingest_seq, e.email FROM turns t JOIN {emails} e ON e.site_key = t.key WHERE e.site_key <> ''),
uniq AS (SELECT id, email, min((side, ingest_seq)) AS place FROM found GROUP BY id, email),
joined AS (SELECT id, string_agg(email, ' / ' ORDER BY place) AS emails FROM uniq GROUP BY id)
SELECT coalesce(name, '') AS entreprise, category AS categorie, address AS adresse, postal_code AS code_postal, city AS ville, phone AS telephone, coalesce(phones, '') AS telephone_site, coalesce(j.emails, '') AS emails,
  coalesce(nullif(website, ''), CASE WHEN key <> '' THEN 'https://' || key || '/' ELSE '' END) AS site_web, siren, naf, source
FROM turns t LEFT JOIN joined j ON j.id = t.id WHERE NOT chain OR turn = 1""")
def export_phones(t):
    return X.phone_rows(*(t(n) for n in ("businesses", "emails", "guesses", "phones")))


@_register("""
SELECT 'businesses by source' AS metric, source AS key, count(*) AS value FROM {businesses} GROUP BY source UNION ALL SELECT 'businesses by category', category, count(*) FROM {businesses} GROUP BY category
UNION ALL SELECT 'sites by status', status, count(*) FROM {sites} GROUP BY status UNION ALL SELECT 'addresses by kind', kind, count(DISTINCT email) FROM {emails} GROUP BY kind
UNION ALL SELECT 'addresses', 'all', count(DISTINCT email) FROM {emails} UNION ALL SELECT 'domains by answer', CASE WHEN ok THEN 'ok' WHEN NOT ok THEN 'ko' ELSE '?' END, count(*) FROM {mx} GROUP BY 2""")
def stats_summary(t):
    return X.stats(*(t(n) for n in ("businesses", "sites", "emails", "mx")))


@_register("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def status_last_wins(t):
    rows = t("events").select("user_id", "event_type", "event_id", "ts")
    return S.replace_rows(rows.limit(0), rows, ["user_id"], F.struct("ts", "event_id")).select("user_id", "event_type", "event_id")


@_register("""SELECT 'node/' || CAST(n_nationkey AS VARCHAR) AS source_id, CASE WHEN n_nationkey % 3 = 0 THEN 'Carrosserie ' || n_name WHEN n_nationkey % 3 = 1 THEN n_name ELSE '' END AS name,
  CASE WHEN n_nationkey % 3 = 0 THEN 'carrosserie' ELSE 'garage' END AS category, CASE WHEN n_nationkey % 3 = 2 THEN 'site' || CAST(n_nationkey AS VARCHAR) || '.fr' ELSE '' END AS website FROM nation WHERE n_nationkey % 5 <> 4""")
def osm_tags_to_business(t):
    tags = F.expr("""map_from_entries(filter(array(struct('shop', CASE WHEN n_nationkey % 5 = 4 THEN 'bakery' ELSE 'car_repair' END), struct('name', CASE WHEN n_nationkey % 3 = 0 THEN 'Carrosserie ' || n_name END),
      struct('brand', CASE WHEN n_nationkey % 3 = 1 THEN n_name ELSE '' END), struct('url', CASE WHEN n_nationkey % 3 = 2 THEN 'site' || CAST(n_nationkey AS STRING) || '.fr' END)), x -> x.col2 IS NOT NULL))""")
    rows = t("nation").select(F.lit("node").alias("type"), F.col("n_nationkey").cast("long").alias("id"), *(F.lit(None).cast("double").alias(c) for c in ("lat", "lon")), F.lit(None).cast("struct<lat: double, lon: double>").alias("center"), tags.alias("tags"))
    return maps.businesses(rows).select("source_id", "name", "category", "website")


@_register("""SELECT CASE WHEN c_custkey % 4 = 3 THEN 'h' ELSE 'e' || CAST(k AS VARCHAR) || '-' END || CAST(c_custkey AS VARCHAR) AS source_id, CASE WHEN c_custkey % 4 <> 3 AND k = 0 THEN 'Enseigne' ELSE c_name END AS name,
  CASE WHEN c_custkey % 4 <> 3 AND k = 0 THEN c_name ELSE '' END AS alt_name FROM customer, (VALUES (0), (1)) v(k) WHERE c_custkey % 10 <> 0 AND (c_custkey % 4 <> 3 OR k = 0)""")
def register_explode(t):
    fields = "siret: string, etat_administratif: string, liste_enseignes: array<string>, nom_commercial: string, adresse: string, code_postal: string, libelle_commune: string, activite_principale: string, latitude: string, longitude: string"
    json = F.expr("""'{"siren":"1","nom_complet":"' || CASE WHEN c_custkey % 10 = 0 THEN '[NON-DIFFUSIBLE]' ELSE c_name END || '","siege":{"siret":"h' || CAST(c_custkey AS STRING) || '"},"matching_etablissements":[{"siret":"e0-' || CAST(c_custkey AS STRING) || '","etat_administratif":"'
      || CASE WHEN c_custkey % 4 = 3 THEN 'F' ELSE 'A' END || '","liste_enseignes":["Enseigne"]},{"siret":"e1-' || CAST(c_custkey AS STRING) || '"' || CASE WHEN c_custkey % 4 = 3 THEN ',"etat_administratif":"F"' ELSE '' END || '}]}'""")
    schema = f"struct<siren: string, nom_complet: string, nom_raison_sociale: string, activite_principale: string, siege: struct<{fields}>, matching_etablissements: array<struct<{fields}>>>"
    rows = t("customer").select(F.from_json(json, schema).alias("r")).select("r.*", F.lit("concession").alias("category"), F.lit("45.11Z").alias("naf"))
    return register.businesses(rows).select("source_id", "name", "alt_name")


@_register()
def html_unescape_pages(t):
    return t("pages").select("page_id", T.html_unescape(F.col("html")).alias("text"))


@_register("SELECT page_id, html AS text FROM pages")
def decode_body(t):
    return t("pages").select("page_id", T.decode_body(F.col("html").cast("binary"), F.lit(None).cast("string")).alias("text"))


@_register("SELECT page_id, NOT regexp_matches(url, '^[a-z]+://[^/]*/(de|fr)/') OR page_id % 3 = 0 AS allowed FROM pages")
def robots_allowed(t):
    body = F.lit("User-agent: *\nDisallow: /de/\nDisallow: /fr/\n")
    status = F.when(F.col("page_id") % 3 == 0, 404).otherwise(200)
    return t("pages").select("page_id", T.can_fetch(status, body, F.lit("kontor"), F.col("url")).alias("allowed"))


@_register("""
WITH x AS (SELECT l_orderkey, lpad(CAST(l_orderkey AS VARCHAR), 9, '7') AS number, CASE WHEN l_linenumber % 2 = 0 THEN '1' ELSE '' END AS more FROM lineitem)
SELECT count(*) AS n, count(DISTINCT l_orderkey) AS orders, count(CASE WHEN regexp_matches('siren ' || number || more || ' x', '(^|[^0-9])' || number || '([^0-9]|$)') THEN 1 END) AS proven FROM x""")
def tokens_at_scale(t):
    """The same check of company numbers over the largest table; every other number stands within a longer one."""
    number = F.lpad(F.col("l_orderkey").cast("string"), 9, "7")
    text = F.concat(F.lit("siren "), number, F.when(F.col("l_linenumber") % 2 == 0, "1").otherwise(""), F.lit(" x"))
    proven = N.verify_tokens(text, N.business_tokens(F.lit(""), number))
    return t("lineitem").select("l_orderkey", proven.cast("int").alias("p")).agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("orders"), F.sum("p").alias("proven"))
