"""Column functions on small inputs with known results."""

import base64

import pytest
from pyspark.sql import functions as F

from kontor.functions import email as E
from kontor.functions import links as L
from kontor.functions import names as N
from kontor.functions import phone as P
from kontor.functions import text as T
from kontor.functions import url as U
from kontor.policy import DEFAULT, departments


def one(spark, column, **values):
    """The value of a column over one row of strings."""
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()[0]


def emails(spark, html):
    rows = spark.createDataFrame([(html,)], "html string")
    return set(E.with_emails(rows).first()["emails"])


def hidden(text, key):
    return f"{key:02x}" + "".join(f"{ord(c) ^ key:02x}" for c in text)


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ('<a href="mailto:Marie%40atelier-lune.fr?subject=Devis">x</a> ou jean@atelier-lune.fr.', {"marie@atelier-lune.fr", "jean@atelier-lune.fr"}),
        ('paul&#64;atelier-lune.fr <script>var m="rose\\u0040atelier-lune.fr"</script>', {"paul@atelier-lune.fr", "rose@atelier-lune.fr"}),
        ("luc [at] atelier-lune [dot] fr, lea (at) atelier-lune.fr", {"luc@atelier-lune.fr", "lea@atelier-lune.fr"}),
        (f'<a href="/cdn-cgi/l/email-protection#{hidden("ana@lune.fr", 0x5A)}"></a><b data-cfemail="{hidden("eve@lune.fr", 0x21)}"></b>', {"ana@lune.fr", "eve@lune.fr"}),
        ("logo@2x.png votre@email.fr @media (max-width) 0123456789abcdef0123@lune.fr no-reply@lune.fr a@sub.example.com", set()),
        ("'zoe' + '@' + 'lune.fr' max @ lune.fr, tom arobase lune point fr <i data-user=\"sam\" class=x data-domain=\"lune.fr\">", {"zoe@lune.fr", "max@lune.fr", "tom@lune.fr", "sam@lune.fr"}),
        ("Contactez\n@lune.fr", set()),
        ("un@a.fr@b.fr", {"un@a.fr", "a.fr@b.fr"}),
        ('<a href="data:text/vcard;charset=utf-8,EMAIL%3Aida%40lune.fr">', {"ida@lune.fr"}),
        (f'<a href="data:text/vcard;base64,{base64.b64encode(b"EMAIL:ugo@lune.fr").decode().rstrip("=")}">', {"ugo@lune.fr"}),
        ('<a href="mailto:a+b@lune.fr,c@lune.fr">', {"a+b@lune.fr", "c@lune.fr"}),
        ("", set()),
        (None, set()),
    ],
)
def test_addresses_of_pages(spark, html, expected):
    assert emails(spark, html) == expected


@pytest.mark.parametrize(
    ("raw", "expected"),
    [("MailTo:Bob@Lune.FR.", "bob@lune.fr"), ("a..b@lune.fr", None), ("a@lune", None), ("a@b@c.fr", None), (" <x@lune.fr> ", "x@lune.fr"), ("x@lune.png", None), ("x" * 65 + "@lune.fr", None), ("x@votresite.fr", None), (None, None)],
)
def test_cleaning(spark, raw, expected):
    assert one(spark, E.clean_email(F.col("a")), a=raw) == expected


def test_kind_and_role(spark):
    kind = lambda e: one(spark, E.email_kind(F.col("a"), F.array(F.lit("lune.fr"))), a=e)
    assert [kind(e) for e in ("a@mail.lune.fr", "a@gmail.com", "a@autre.fr")] == ["domaine_site", "gratuit", "pro"]
    assert one(spark, E.is_role(F.col("a")), a="contact+web@lune.fr") and not one(spark, E.is_role(F.col("a")), a="marie@lune.fr")


def test_phones(spark):
    text = '<a href="tel:+33 1 23 45 67 89">x</a> 04.72.00.11.22, 06 12 34 56 78; siret 12345678900012 et 0123456789012'
    assert set(one(spark, P.extract_phones(F.col("a")), a=text)) == {"01 23 45 67 89", "04 72 00 11 22", "06 12 34 56 78"}
    assert one(spark, P.normalised(F.col("a")), a="0033 (0) 4") is None


@pytest.mark.parametrize(
    ("host", "expected"),
    [("www.lune.fr", "lune.fr"), ("a.b.lune.co.uk", "lune.co.uk"), ("10.0.0.1", "10.0.0.1"), ("shop.lune.com", "lune.com"), ("lune", "lune"), (None, "")],
)
def test_registrable(spark, host, expected):
    assert one(spark, U.registrable(F.col("a")), a=host) == expected


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("WWW.Lune.fr", ("lune.fr", "https://WWW.Lune.fr/")),
        ("http://lune.fr:8080/a?b#c; http://x.fr", ("lune.fr", "http://lune.fr:8080/a")),
        ("https://www.facebook.com/lune", (None, None)),
        ("https://sites.google.com/view/lune/x", ("sites.google.com/view/lune", "https://sites.google.com/view/lune/x")),
        ("ftp://lune.fr", (None, None)),
        ("", (None, None)),
        (None, (None, None)),
    ],
)
def test_site_from_url(spark, raw, expected):
    assert tuple(one(spark, U.site_from_url(F.col("a")), a=raw)) == expected


def test_page_identity_and_home(spark):
    assert one(spark, U.page_identity(F.col("a")), a="https://www.Lune.fr/x//?q=1#z") == "lune.fr/x?q=1"
    assert one(spark, U.home_candidates(F.col("a")), a="http://lune.fr/x") == ["http://lune.fr/x", "http://www.lune.fr/x", "https://lune.fr/x", "http://lune.fr/"]


def test_candidate_domains(spark):
    def found(name, city):
        rows = spark.createDataFrame([(name, city)], "n string, c string").select(N.words(F.col("n")).alias("n"), N.words(F.col("c")).alias("c"))
        return set(rows.select(N.candidate_domains(F.col("n"), F.col("c"))).first()[0])

    assert found("SARL Garage Durand (M. X)", "Lyon") >= {"garagedurand.fr", "garage-durand.com", "garagedurand.net", "garage-durand-lyon.fr", "durand.fr", "durand-auto.fr"}
    assert found("Garage Auto", "Lyon") == set() and found("", "") == set()
    assert "lecoledete.fr" in found("L'École d'Été", "")


def test_tokens(spark):
    verified = lambda text, *tokens: spark.createDataFrame([(text, list(tokens))], "a string, t array<string>").select(N.verify_tokens(F.col("a"), F.col("t"))).first()[0]
    assert verified("SIREN 123 456 789", "123456789") and verified("69007 Lyon", "75001", "69007")
    assert not verified("ref 690071", "69007") and not verified("rien", "69007") and not verified("x")
    assert one(spark, N.business_tokens(F.col("a"), F.col("b")), a=" 69007 ", b="12") == ["69007"]


def test_refine_category(spark):
    fine = lambda c, n: one(spark, N.refine_category(F.col("a"), F.col("b")), a=c, b=n)
    assert [fine("garage", "CARROSSERIE Dupré"), fine("garage", "CONTRÔLE technique"), fine("pieces", "Épneu"), fine("concession", "Pneus"), fine("garage", None)] == ["carrosserie", "controle_technique", "pieces", "concession", "garage"]


PAGE = """<a href="/contact">Nous écrire</a> <a href='/mentions-legales'>Mentions</a><A HREF=/agence-lyon>Agence</A><a href="https://ailleurs.fr/contact">x</a>
<a href="/plan.pdf">contact</a><a href="#top">contact</a><a href="https://garage-bleu.fr/x">Notre partenaire</a><a href="https://www.facebook.com/g">garage</a><a href="https://lune.fr/garage">garage</a><a href="https://cuisine.fr/">Recettes</a>"""


def test_links(spark):
    rows = spark.createDataFrame([(1, "https://lune.fr/", PAGE)], "page_id long, url string, html string")
    anchors = L.anchors(rows)
    contact = [r["url"] for r in L.discover_links(anchors).orderBy("rank").collect()]
    assert contact == ["https://lune.fr/contact", "https://lune.fr/mentions-legales"]
    inner = [r["url"] for r in L.internal_links(anchors).orderBy("rank").collect()]
    assert inner == ["https://lune.fr/contact", "https://lune.fr/agence-lyon", "https://lune.fr/garage", "https://lune.fr/mentions-legales"]
    assert {r["url"] for r in L.external_sites(anchors).collect()} == {"https://garage-bleu.fr/"}


def test_bodies_and_robots(spark):
    decode = lambda b, c=None: spark.createDataFrame([(bytearray(b), c)], "b binary, c string").select(T.decode_body(F.col("b"), F.col("c"))).first()[0]
    assert decode("é".encode()) == "é" and decode("é€".encode("cp1252")) == "é€"
    assert decode('<meta charset="latin-1">é'.encode("latin-1")).endswith("é") and decode("é".encode(), "nosuch") == "é"
    allowed = lambda s, b, u: spark.createDataFrame([(s, b, u)], "s int, b string, u string").select(T.can_fetch(F.col("s"), F.col("b"), F.lit("x"), F.col("u"))).first()[0]
    rules = "User-agent: *\nDisallow: /prive/"
    assert allowed(200, rules, "https://a.fr/x") and not allowed(200, rules, "https://a.fr/prive/x")
    assert not allowed(403, None, "https://a.fr/") and allowed(404, rules, "https://a.fr/prive/") and allowed(None, None, "https://a.fr/")


def test_lists():
    assert len(departments()) == 101 and {"01", "2A", "2B", "976"} <= set(departments()) and "20" not in departments()
    assert len(DEFAULT.categories) == 17 and len(DEFAULT.free_domains) == 49 and len(DEFAULT.role_locals) == 43
