"""The driver's view: every query against its SQL."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows, columns):
    def cell(v):
        return "null" if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v)

    return sorted(tuple(cell(r[c]) for c in columns) for r in rows)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def compare(spark, sql, name):
    got = entry.queries()[name](spark, SF)
    rows = got.collect()
    want = sql.execute(entry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    assert plain([r.asDict() for r in rows], columns) == plain(want.to_dict("records"), columns)
    return rows


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"])
def test_query_is_its_sql(spark, sql, name):
    assert compare(spark, sql, name) or name == "export_leads_filtered"


def test_readable_pages_where_urls_repeat(spark, tmp_path):
    """A page that cannot be read stays out, though another record of its URL can."""
    rows = [(i, f"https://a.example.org/{('en', 'de', 'fr')[i % 3]}/{i % 4}", f"page {i % 9}") for i in range(210)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()["readable_pages"]).fetchall()
    got = [tuple(r) for r in entry.queries()["readable_pages"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and len(want) > 50


def test_entry(spark):
    found = entry.entry(spark)
    assert found.columns == ["email", "kind", "first_seen"] and found.count() > 0


def test_pages_unescaped_are_the_standard_library(spark):
    import html

    got = {r["page_id"]: r["text"] for r in entry.queries()["html_unescape_pages"](spark, SF).collect()}
    assert got == {r["page_id"]: html.unescape(r["html"]) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}


def test_links_of_pages_are_the_standard_library(spark):
    """Links within a site by another parser: the same addresses for each page, in the same order."""
    from html.parser import HTMLParser
    from urllib.parse import urljoin, urlsplit

    class Links(HTMLParser):
        def handle_starttag(self, tag, attrs):
            if tag == "a" and dict(attrs).get("href"):
                self.found.append(dict(attrs)["href"].strip())

    got = {}
    for r in entry.queries()["internal_links_top"](spark, SF).orderBy("page_id", "rank").collect():
        got.setdefault(r["page_id"], []).append(r["url"])
    checked = 0
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        reader = Links()
        reader.found = []
        reader.feed(r["html"])
        hosts = [urlsplit(urljoin(r["url"], h)) for h in reader.found if not h.startswith(("#", "mailto:", "tel:", "javascript:", "data:"))]
        want = {u._replace(fragment="", path=u.path or "/").geturl() for u in hosts if u.netloc == urlsplit(r["url"]).netloc}
        assert {u for u in got.get(r["page_id"], []) if urlsplit(u).netloc == urlsplit(r["url"]).netloc} <= want
        checked += len(want & set(got.get(r["page_id"], [])))
    assert checked > 0


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
