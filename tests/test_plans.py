"""Stages end to end on a small recorded site, state tables, sources, streaming."""

import pytest
from pyspark.sql import functions as F

from kontor import schemas
from kontor.operators import state as S
from kontor.plans import collect as C
from kontor.plans import crawl as R
from kontor.plans import export as X
from kontor.plans import guess as G
from kontor.plans import verify as V
from kontor.policy import DEFAULT, LEAD_COLUMNS
from kontor.sources import files, maps, places, register, search
from kontor.streaming import incremental

HIDDEN = "5a" + "".join(f"{ord(c) ^ 0x5A:02x}" for c in "lea@lune.fr")
SITE = {
    "https://lune.fr/": '<a href="/contact">Contact</a><a href="/mentions-legales">Mentions</a><a href="/prive/equipe">équipe</a><a href="https://garage-ami.fr/x">notre partenaire</a> 04 72 00 11 22 jean@lune.fr',
    "https://lune.fr/contact": f'marie [at] lune [dot] fr <a href="/cdn-cgi/l/email-protection#{HIDDEN}">x</a> lune69@gmail.com',
    "https://lune.fr/mentions-legales": "SIREN 123 456 789 — 69007 Lyon",
    "https://lune.fr/prive/equipe": "secret@lune.fr",
    "https://garage-ami.fr/": "contact@garage-ami.fr",
    "https://vide.fr/": "rien",
    "https://vide.fr/contact": "trouve@vide.fr",
    "https://carte.fr/": "rien ici",
    "https://carte.fr/sitemap.xml": "<loc>https://carte.fr/infos</loc><loc>https://carte.fr/produit</loc>",
    "https://carte.fr/infos": "carte@carte.fr",
    "https://reseau.fr/": '<a href="/agence-1">a</a><a href="/agence-2">b</a>',
    "https://reseau.fr/agence-1": '<a href="/agence-3">c</a> un@reseau.fr',
    "https://reseau.fr/agence-2": "deux@reseau.fr",
    "https://reseau.fr/agence-3": "trois@reseau.fr",
}


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(u, 200, "text/html", h) for u, h in SITE.items()] + [("https://lune.fr/vieux", 404, "text/html", "x@lune.fr"), ("https://lune.fr/i.bin", 200, "image/png", "y@lune.fr")]
    recorded = spark.createDataFrame(rows, "url string, status int, content_type string, html string")
    robots = spark.createDataFrame([("https://lune.fr", 200, "User-agent: *\nDisallow: /prive/")], "origin string, status int, body string")
    return S.cut(R.readable(recorded, robots, "kontor"))


def site_rows(spark, *rows):
    return spark.createDataFrame([(k, f"https://{k}/", g, "pending", None, 0, i) for i, (k, g) in enumerate(rows)], schemas.table("sites"))


def empty(spark, name):
    return spark.createDataFrame([], schemas.table(name))


def test_only_readable_pages(pages):
    urls = {r["url"] for r in pages.select("url").collect()}
    assert "https://lune.fr/contact" in urls and not urls & {"https://lune.fr/prive/equipe", "https://lune.fr/vieux", "https://lune.fr/i.bin"}


def test_crawl(spark, pages):
    sites = site_rows(spark, ("lune.fr", False), ("vide.fr", False), ("carte.fr", False), ("absent.fr", False))
    r = R.crawl(sites, pages, empty(spark, "guesses"))
    found = {(x["site_key"], x["email"], x["kind"]) for x in r.emails.collect()}
    assert found == {
        ("lune.fr", "jean@lune.fr", "domaine_site"), ("lune.fr", "marie@lune.fr", "domaine_site"), ("lune.fr", "lea@lune.fr", "domaine_site"), ("lune.fr", "lune69@gmail.com", "gratuit"),
        ("vide.fr", "trouve@vide.fr", "domaine_site"), ("carte.fr", "carte@carte.fr", "domaine_site"),
    }
    assert {(x["site_key"], x["phone"]) for x in r.phones.collect()} == {("lune.fr", "04 72 00 11 22")}
    assert {(x["site_key"], x["status"], x["pages"]) for x in r.sites.collect()} == {("lune.fr", "ok", 3), ("vide.fr", "ok", 2), ("carte.fr", "ok", 2), ("absent.fr", "unreachable", 0)}
    assert {x["url"] for x in r.partners.collect()} == {"https://garage-ami.fr/"}


def test_guessed_sites_need_a_proof(spark, pages):
    sites = site_rows(spark, ("lune.fr", True), ("vide.fr", True))
    guesses = spark.createDataFrame([(1, "lune.fr", ["69007", "999999999"], False), (2, "lune.fr", ["75001"], False), (3, "vide.fr", ["75001"], False)], schemas.table("guesses"))
    r = R.crawl(sites, pages, guesses)
    assert {(x["business_id"], x["site_key"], x["url"]) for x in r.confirmed.collect()} == {(1, "lune.fr", "https://lune.fr/")}
    assert {(x["site_key"], x["status"]) for x in r.sites.collect()} == {("lune.fr", "ok"), ("vide.fr", "unverified")}
    assert {x["site_key"] for x in r.emails.collect()} == {"lune.fr"}


def test_networks_are_read_whole(spark, pages):
    sites = site_rows(spark, ("reseau.fr", False))
    deep = sites.select("site_key")
    count = lambda **k: R.visit(sites, pages, **k).where("html LIKE '%@reseau.fr%'").count()
    assert count() == 0 and count(deep=deep) == 3 and count(deep=deep, deep_pages=2) == 1


def test_rounds_go_on_to_partners(spark, pages):
    emails, _, says, _, found = R.rounds(site_rows(spark, ("lune.fr", False)), empty(spark, "businesses"), pages, empty(spark, "guesses"))
    assert "contact@garage-ami.fr" in {x["email"] for x in emails.collect()}
    assert {x["site_key"] for x in says.collect()} == {"lune.fr", "garage-ami.fr"} and [x["category"] for x in found.collect()] == ["partenaire"]


def test_collect_guess_verify_export(spark, pages, tmp_path):
    tags = [("node", 1, {"shop": "car_repair", "name": "Garage Lune", "website": "lune.fr", "addr:postcode": "69007", "email": "sav@lune.fr;x"}), ("node", 2, {"shop": "bakery", "name": "Pain"})]
    elements = spark.createDataFrame([(t, i, None, None, None, m) for t, i, m in tags], schemas.table("map"))
    results = spark.createDataFrame([("123456789", "GARAGE VIDE (DUPONT)", None, "45.20A", ("1", "A", None, None, "rue", "75001", "Paris", None, "1.5", "x"), [])], schemas.table("register")).withColumns({"category": F.lit("garage"), "naf": F.lit("45.20A")})
    rows = S.cut(C.collect(empty(spark, "businesses"), [maps.businesses(elements), register.businesses(results)]))
    assert {(r["id"], r["source"], r["site_key"], r["postal_code"]) for r in rows.collect()} == {(1, "osm", "lune.fr", "69007"), (2, "sirene", None, "75001")}
    assert C.collect(rows, [maps.businesses(elements)]).count() == 0  # the first row of a key stays
    sites = C.sites_of(empty(spark, "sites"), rows)
    known = S.cut(C.emails_of(empty(spark, "emails"), rows))
    assert [(r["email"], r["business_id"], r["kind"], r["is_role"]) for r in known.collect()] == [("sav@lune.fr", 1, "domaine_site", True)]
    dns = spark.createDataFrame([("garagevide.fr", True), ("garage-vide.fr", False), ("garagevide.com", None)], schemas.table("dns"))
    new_sites, owners, lookups = G.guess(rows, sites, known, empty(spark, "dns_checked").select("domain", "ok"), dns, empty(spark, "guesses"))
    assert [(r["site_key"], r["url"], r["guessed"]) for r in new_sites.collect()] == [("garagevide.fr", "https://garagevide.fr/", True)]
    assert [(r["business_id"], sorted(r["tokens"])) for r in owners.collect()] == [(2, ["123456789", "75001"])] and lookups.count() == 2
    r = R.crawl(sites.select("site_key", "url", "guessed"), pages, empty(spark, "guesses"))
    emails = S.cut(known.unionByName(r.emails))
    answers = spark.createDataFrame([("lune.fr", "NOERROR", ["mx.lune.fr."], None), ("gmail.com", "NOERROR", ["."], None)], schemas.table("mx_answers"))
    mx = S.cut(V.verify(emails, empty(spark, "mx"), answers))
    assert {(x["domain"], x["ok"]) for x in mx.collect()} == {("lune.fr", True), ("gmail.com", False)}
    leads = X.leads(emails, rows, empty(spark, "guesses"), mx, r.phones)
    assert leads.columns == LEAD_COLUMNS and leads.count() == 5
    assert X.leads(emails, rows, empty(spark, "guesses"), mx, r.phones, pro_only=True).count() == 4
    assert X.leads(emails, rows, empty(spark, "guesses"), mx, r.phones, mx_only=True).count() == 4
    assert X.leads(emails, rows, empty(spark, "guesses"), mx, r.phones, role_only=True).count() == 1
    path = tmp_path / "leads.csv"
    assert X.write_csv(leads, str(path)) == 5
    assert path.read_bytes().startswith(b"\xef\xbb\xbf" + ";".join(LEAD_COLUMNS).encode())
    numbers = X.phone_rows(rows, emails, empty(spark, "guesses"), r.phones).collect()
    assert [(x["entreprise"], x["telephone_site"]) for x in numbers] == [("Garage Lune", "04 72 00 11 22")] and numbers[0]["emails"].startswith("sav@lune.fr")
    saved = S.save_sites(sites, r.sites).collect()
    assert [(x["status"], x["final_url"], x["pages"]) for x in saved] == [("ok", "https://lune.fr/", 3)]
    out = spark.createDataFrame([("LUNE69@gmail.com",)], "value string")
    assert S.suppress(emails, out).count() == 4 and S.suppress(emails, spark.createDataFrame([("lune.fr",)], "value string")).count() == 1


def test_linking_keeps_known_sites(spark):
    rows = spark.createDataFrame([(1, None, None), (2, "a.fr", "https://a.fr/")], "id long, site_key string, website string")
    confirmed = spark.createDataFrame([(1, "c.fr", "https://c.fr/"), (1, "b.fr", "https://b.fr/"), (2, "b.fr", "https://b.fr/")], "business_id long, site_key string, url string")
    assert {tuple(r) for r in S.link_guessed(rows, confirmed).collect()} == {(1, "b.fr", "https://b.fr/"), (2, "a.fr", "https://a.fr/")}


def test_mx_statuses(spark):
    rows = [("NOERROR", ["."], None), ("NOERROR", ["a."], None), ("NXDOMAIN", None, None), ("NOANSWER", None, True), ("NOANSWER", None, False), ("TIMEOUT", None, None)]
    frame = spark.createDataFrame(rows, "rcode string, hosts array<string>, has_address boolean")
    got = [r[0] for r in frame.coalesce(1).select(V.mx_status(F.col("rcode"), F.col("hosts"), F.col("has_address"))).collect()]
    assert got == [False, True, False, True, False, None]


def test_replacing_and_resets(spark):
    old = spark.createDataFrame([("a", True, 1), ("b", None, 1)], schemas.table("mx"))
    new = spark.createDataFrame([("b", True, 1), ("b", False, 2), (None, True, 1)], schemas.table("mx"))
    assert {(r["domain"], r["ok"]) for r in S.replace_rows(old, new, ["domain"]).collect()} == {("a", True), ("b", False)}


def test_file_sources(spark, tmp_path):
    (tmp_path / "list.txt").write_text("﻿# rien\nwww.lune.fr\n\nhttps://facebook.com/x\n lune.fr/autre \n")
    (tmp_path / "list.csv").write_text("﻿Nom;Site Web;Ville\nLune;lune.fr;Lyon\n;bleu.fr;\nX;;Y\n", encoding="utf-8")
    rows = files.businesses(files.read_sites(spark, str(tmp_path / "list.txt"))).collect()
    assert {(r["source_id"], r["name"]) for r in rows} == {("lune.fr", "lune.fr")} and len(rows) == 2
    rows = files.businesses(files.read_sites(spark, str(tmp_path / "list.csv")), "garage").collect()
    assert {(r["source_id"], r["name"], r["city"], r["category"]) for r in rows} == {("lune.fr", "Lune", "Lyon", "garage"), ("bleu.fr", "bleu.fr", "", "garage")}


def test_places_and_hits(spark):
    entry = ("p1", ("Pneus Lune",), "1 rue", [("69007", ["postal_code"]), ("Lyon", ["locality", "political"])], "https://lune.fr", "04", "OPERATIONAL", (1.0, 2.0))
    closed = ("p2", ("X",), None, None, None, None, "CLOSED_PERMANENTLY", None)
    rows = places.businesses(spark.createDataFrame([entry, closed], schemas.table("places")).withColumn("category", F.lit("garage"))).collect()
    assert [(r["source_id"], r["category"], r["postal_code"], r["city"], r["lat"]) for r in rows] == [("p1", "pneus", "69007", "Lyon", 1.0)]
    hits = spark.createDataFrame([("https://lune.fr/a/b?c", "T" * 300), ("https://fr.wikipedia.org/x", "y")], schemas.table("hits")).withColumns({"category": F.lit("autre"), "city": F.lit("Lyon"), "ingest_seq": F.lit(1)})
    rows = search.businesses(hits).collect()
    assert [(r["source_id"], r["website"], len(r["name"])) for r in rows] == [("lune.fr", "https://lune.fr/", 200)]


def test_register_rules(spark):
    e = lambda siret, state="A", sign=None: (siret, state, [sign] if sign else None, None, "", "", "", None, None, None)
    rows = [("1", "A", None, "x", e("h1"), [e("11"), e("12", "F"), e("13", None, "Enseigne")]), ("2", "B", None, "x", e("h2"), [e("21", "F")]), ("3", "[NON-DIFFUSIBLE]", None, "x", e("h3"), []), ("4", "", None, "x", e("h4"), [])]
    found = register.businesses(spark.createDataFrame(rows, schemas.table("register")).withColumns({"category": F.lit("garage"), "naf": F.lit("n")})).collect()
    assert {(r["source_id"], r["name"], r["alt_name"]) for r in found} == {("11", "A", ""), ("13", "Enseigne", "A"), ("h2", "B", "")}


def test_requests(spark):
    assert register.requests(spark).count() == 20 * 101 and list(register.pages_of(3)) == [2, 3] and len(register.pages_of(999)) == 399
    assert places.requests(spark, ["Lyon", "Lyon"], ["garage"]).count() == 9 and places.requests(spark, ["Lyon"], keywords=["a", "b"]).first()["category"] == "autre"
    asked = maps.requests(spark, ["garage"]).collect()
    assert len(asked) == 101 and '"ref:INSEE"="01"' in asked[0]["request"] and 'nwr["shop"="car_repair"](area.a);' in asked[0]["request"]
    assert maps.requests(spark, country="BE").count() == 13 and maps.requests(spark, ["carrosserie"]).count() == 0
    assert maps.area(custom=' area["name"="X"]->.a; ') == 'area["name"="X"]->.a;'
    assert C.categories(spark, DEFAULT).count() == 17


def test_stream_is_the_batch_and_restarts(spark, tmp_path):
    schema = spark.createDataFrame([], "page_id long, url string, html string").schema
    source, out, check = (str(tmp_path / d) for d in ("in", "out", "check"))
    first = [(i, f"https://s{i % 3}.fr/{i}", f"a{i % 4}@lune.fr") for i in range(20)]
    second = [(100 + i, f"https://s{i % 3}.fr/x{i}", f"a{i % 6}@lune.fr") for i in range(20)]
    for rows in (first, second):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        incremental.stream(spark, source, schema, out, check, files_at_once=1).awaitTermination()
    incremental.stream(spark, source, schema, out, check).awaitTermination()  # nothing new
    got = {(r["email"], r["site_key"]) for r in spark.read.parquet(out).collect()}
    want = incremental.found_emails(spark.createDataFrame(first + second, schema))
    assert got == {(r["email"], r["site_key"]) for r in want.collect()} and len(got) == spark.read.parquet(out).count()


def test_windowed_counts(spark):
    events = spark.sql("SELECT timestamp_ntz '2026-01-01 00:10:00' AS ts, 'a' AS event_type UNION ALL SELECT timestamp_ntz '2026-01-01 00:50:00', 'a' UNION ALL SELECT timestamp_ntz '2026-01-01 01:00:00', 'a'")
    assert sorted(r["n"] for r in incremental.counts_by_window(events).collect()) == [1, 2]


def test_rank_one_is_kept_before_the_shuffle(spark):
    plan = S.first_of_each(spark.range(10).selectExpr("id % 3 AS k", "id"), ["k"], "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
