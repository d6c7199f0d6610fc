"""The command line and the directory in a folder, from recorded inputs to files."""

import json

import pytest

from kontor.__main__ import main
from kontor.operators.store import Store
from kontor.plans import directory as D
from tests.test_plans import SITE


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("inputs")
    (at / "osm.json").write_text(json.dumps({"type": "node", "id": 1, "tags": {"shop": "car_repair", "name": "Garage Lune", "website": "https://lune.fr", "addr:postcode": "69007"}}))
    (at / "sirene.json").write_text(json.dumps({"siren": "123456789", "nom_complet": "GARAGE VIDE", "siege": {"siret": "1", "code_postal": "75001"}, "category": "garage", "naf": "45.20A"}))
    (at / "out.txt").write_text("lune69@gmail.com\n")
    spark.createDataFrame([(u, 200, "text/html", h) for u, h in SITE.items()], "url string, status int, content_type string, html string").write.parquet(str(at / "pages"))
    spark.createDataFrame([("https://lune.fr", 200, "User-agent: *\nDisallow: /prive/")], "origin string, status int, body string").write.parquet(str(at / "robots"))
    spark.createDataFrame([("garagevide.fr", True)], "domain string, ok boolean").write.parquet(str(at / "dns"))
    spark.createDataFrame([("lune.fr", "NOERROR", ["mx."], None)], "domain string, rcode string, hosts array<string>, has_address boolean").write.parquet(str(at / "mx"))
    return at


def test_run(spark, inputs, tmp_path):
    db, out, phones = str(tmp_path / "db"), tmp_path / "leads.csv", tmp_path / "phones.csv"
    args = ["--osm", "osm.json", "--sirene", "sirene.json", "--dns", "dns", "--pages", "pages", "--robots", "robots", "--mx", "mx", "--opt-out", "out.txt"]
    args = [x if x.startswith("--") else str(inputs / x) for x in args]
    main(["--db", db, "run", *args, "-o", str(out)], spark)
    main(["--db", db, "export", "-o", str(phones), "--telephones", "--categories", "all"], spark)
    rows = out.read_text(encoding="utf-8-sig").splitlines()
    assert len(rows) == 5 and not any("gmail" in r for r in rows)  # three of the site and the partner's
    assert {r.split(";")[0] for r in rows[1:]} == {"jean@lune.fr", "marie@lune.fr", "lea@lune.fr", "contact@garage-ami.fr"}
    assert len(phones.read_text(encoding="utf-8-sig").splitlines()) == 2
    d = D.Directory(spark, db)
    assert {(r["site_key"], r["status"]) for r in d.sites.collect()} == {("lune.fr", "ok"), ("garagevide.fr", "unreachable"), ("garage-ami.fr", "ok")}
    assert {r["source"] for r in d.businesses.collect()} == {"osm", "sirene", "lien"} and d.businesses.select("id").distinct().count() == 3
    n = d.emails.count()
    main(["--db", db, "crawl", "--pages", str(inputs / "pages"), "--robots", str(inputs / "robots"), "--no-partners", "--retry-failed", "--recrawl-no-email"], spark)
    assert d.emails.count() == n  # what is known is not added again
    main(["--db", db, "stats"], spark)
    main(["categories"], spark)


def test_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    assert store.read("mx").count() == 0
    for i in range(4):
        store.append("mx", spark.createDataFrame([(f"d{i}", True, i)], store.read("mx").schema))
    assert store.read("mx").count() == 4 and [n[0] for n in store.versions("mx")] == ["a"] * 4
    (tmp_path / "db" / "mx" / "v00000099").mkdir()  # never completed
    assert store.read("mx").count() == 4
    store.PARTS = 3
    store.append("mx", spark.createDataFrame([("d9", None, 9)], store.read("mx").schema))
    assert store.read("mx").count() == 5 and store.versions("mx")[-1] == "v00000005"
    for _ in range(2):
        store.save("mx", store.read("mx").where("domain <> 'd0'"))
    assert store.read("mx").count() == 4 and store.versions("mx") == ["v00000006", "v00000007"]


def test_requests_and_options(spark, tmp_path):
    main(["requests", "--to", str(tmp_path), "--depts", "69,2A", "--categories", "garage", "--cities", "Lyon", "--keywords", "pneus"], spark)
    read = lambda name: spark.read.json(str(tmp_path / name))
    assert {(r["naf"], r["department"]) for r in read("register").collect()} == {("45.20A", "69"), ("45.20A", "2A")}
    assert [r["request"] for r in read("places").collect()] == ["pneus Lyon"] and read("map").count() == 2
    rows = spark.createDataFrame([("69007",), ("20100",), ("75001",), ("97400",)], "postal_code string")
    assert {r[0] for r in D.in_departments(rows, ["69", "2A", "974"]).collect()} == {"69007", "20100", "97400"} and D.in_departments(rows, None).count() == 4
    assert D.may_guess({"sirene"}) and D.may_guess({"gmaps", "osm"}) and not D.may_guess({"osm", "file"})
    for wrong in (["export", "--categories", "x"], ["collect", "--sources", "x"], ["requests", "--depts", "00"]):
        with pytest.raises(ValueError):
            main(["--db", str(tmp_path / "db"), *wrong], spark)


def test_arguments():
    assert D.parse_categories("garage, moto") == ["garage", "moto"] and D.parse_categories(None) is None
    assert D.parse_departments("1,2a,971") == ["01", "2A", "971"]
    assert D.parse_cities("Lyon,Lyon, Paris") == ["Lyon", "Paris"] and len(D.parse_cities(None)) == 60 and len(D.parse_cities("all")) == 152
    assert D.resolve_sources() == {"osm", "sirene"} and D.resolve_sources("auto", "BE", file=True) == {"osm", "file"} and D.resolve_sources("search") == {"search"}
    for wrong in (lambda: D.parse_categories("x"), lambda: D.parse_departments("99"), lambda: D.resolve_sources("x")):
        with pytest.raises(ValueError):
            wrong()
