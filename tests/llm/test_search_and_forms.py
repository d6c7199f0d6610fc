"""Operators 2, 4 and 5: top-k search, URL templates, preferences."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from kontor.llm import preferences, topk, url_templates


def brute_top(rows, k=20):
    out = set()
    usable = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and i is not None]
    for q, a in usable:
        if q % 20 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in usable if i != q and len(a) == len(b))
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])}
    return out


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 100)
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(40)]) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)]  # ties
    rows += [(2000, None), (2020, []), (2040, [float("nan")] * 40), (2060, [None] * 40), (2080, [float("inf")] * 40), (2100, [0.5] * 7), (2101, [0.25] * 7), (None, rows[0][1])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, block int")
    rows = [(r["vec_id"], r["embedding"]) for r in frame.collect()]  # as floats are stored
    vectors = topk.quantised(frame)
    got = {tuple(r) for r in topk.search(vectors, vectors.where(F.col("id") % 20 == 0)).collect()}
    assert got == brute_top(rows)
    none = topk.quantised(frame.limit(0))
    assert topk.search(none, none).collect() == []
    assert topk.search(vectors, none).collect() == []


def test_top_k_of_repeated_rows_and_large_numbers(spark):
    frame = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 1.0]), (1, [3.0, 1.0]), (20, [1e12, 1e12]), (3, [2e8, 3e8])], "vec_id long, embedding array<double>")
    v = topk.quantised(frame)
    got = [tuple(r) for r in topk.search(v, v.where("id = 0")).orderBy("rank").collect()]
    assert got == [(0, 1, 20, 64 * (64 * 10**12) + 128 * (64 * 10**12)), (0, 2, 3, 64 * 64 * 2 * 10**8 + 128 * 64 * 3 * 10**8), (0, 3, 1, 64 * 192 + 128 * 64), (0, 4, 1, 64 * 192 + 128 * 64)]
    assert topk.search(v, v.where("id = 20")).orderBy("rank").first()["score"] == (1 << 63) - 1  # beyond the longs


def test_top_k_prunes():
    """Bounds drop candidates before their last dimensions, and never one that belongs to the result."""
    rng = np.random.default_rng(3)
    rows = np.floor(rng.normal(0, 4, (3000, 64)) * np.exp(-np.arange(64) / 8))
    block = topk.Block(np.arange(3000), rows)
    for q in range(0, 100, 7):
        ids, scores = block.best(q, rows[q], 20)
        want = sorted((-s, i) for i, s in enumerate(rows @ rows[q]) if i != q)[:20]
        assert [(-s, i) for i, s in zip(ids.tolist(), scores.tolist())] == want


def test_top_k_reads_less_than_a_scan(spark):
    """Components read of the table's vectors, by carried thresholds: less than 0.75 of a scan."""
    rows = topk.quantised(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")).toPandas()
    vectors = np.vstack(rows["v"])
    block = topk.Block(rows["id"].to_numpy(), vectors)
    asked = np.flatnonzero(rows["id"].to_numpy() % 20 == 0)
    floors = [block.best(rows["id"][i], vectors[i], 20)[1][-1] for i in asked]
    assert block.read < 0.75 * len(asked) * vectors.size
    block.read = 0
    for i, floor in zip(asked, floors):
        assert len(block.best(rows["id"][i], vectors[i], 20, floor)[0]) == 20
    assert block.read < 0.6 * len(asked) * vectors.size


def test_top_k_of_repeated_queries(spark):
    rows = spark.createDataFrame([(0, [0.0, 5.0]), (0, [5.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    v = topk.quantised(rows)
    assert [tuple(r) for r in topk.search(v, v.where("id = 0")).orderBy("rank").collect()] == [(0, 1, 2, 320 * 64), (0, 2, 1, 0)]


def brute_rule(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.DOTALL)
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]
    best = None
    for said, text in rules:
        name, rest = text.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(text) > len(best[1])):
            best = (said, text)
    return host, path, best


URLS = [
    None, "", "no scheme", "http://", "https://WWW.Example.COM/en/7?x#y", "http://example.com/en/8", "http://com/en/", "http://xcom/en/", "http://É.example.NET/de/81", "http://a.net/de/8", "http://example.net/de/9",
    "http://b.org/es/?q", "http://b.org/es", "http://b.org?x=/es/", "x://y.org/es/a://z", "http://c.fr/" + "a" * 50_000, "http://d.fr/a/b/c/d/e/f/", "http://d.fr//", "http://d.fr/\n/x",
]


def test_rules(spark):
    rows = [(i, u, "host", "rule") for i, u in enumerate(URLS * 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, shape string")
    labels = spark.createDataFrame([(1, True), (None, True), (2, None)], "doc_id long, bad boolean")
    got = {r["page_id"]: r for r in url_templates.judged(pages, labels).collect()}
    assert len(got) == len(rows)
    for i, url, *_ in rows:
        host, path, best = brute_rule(url, url_templates.RULES)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, best[1] if best else None), url
        assert got[i]["verdict"] == (best[0] if best else got[i]["verdict"]) and got[i]["verdict"] in ("allow", "block")
    assert url_templates.judged(pages.limit(0), labels).collect() == []
    assert url_templates.judged(pages, labels.limit(0)).where("rule IS NULL AND verdict = 'block'").count() == 0


def test_templates(spark):
    """Slugs become a wildcard, bad branches are rejected, few labels decide nothing."""
    rows = [(i, f"https://shop.fr/blog/slug-{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}/{i}") for i in range(300)]
    rows += [(1000 + i, f"https://shop.fr/pills/{i}.html") for i in range(60)] + [(2000 + i, f"https://shop.fr/news/{i}") for i in range(60)] + [(3000, "https://shop.fr/about")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(1000 + i, True) for i in range(25)] + [(2000 + i, i == 0) for i in range(25)] + [(i, False) for i in range(50)] + [(3000, True)], "page long, bad boolean")
    got = {r["page_id"]: r for r in url_templates.judged(pages, labels).collect()}
    assert got[5]["template"] == "/blog/*/#" and got[1000]["template"] == "/pills/#.html" and got[2005]["template"] == "/news/#"
    assert {got[1000 + i]["verdict"] for i in range(60)} == {"block"}
    assert {r["verdict"] for k, r in got.items() if k < 1000 or 2000 <= k} == {"allow"}
    assert got == {r["page_id"]: r for r in url_templates.judged(pages.repartition(5), labels).collect()}


def test_similar_branches_merge(spark):
    found = spark.createDataFrame([("h", ["a", x], 100, n, bad) for x, n, bad in (("p", 50, 5), ("q", 50, 7), ("r", 50, 48), ("s", 50, 47), ("t", 0, 0))], "host string, template array<string>, pages long, labelled long, bad long")
    got = {r["template"][-1]: r for r in url_templates.branches(found).collect()}
    assert got["p"]["branch"] == got["q"]["branch"] != got["r"]["branch"] == got["s"]["branch"] and got["p"]["purity"] == got["q"]["purity"] < 0.3 < 0.8 < got["r"]["purity"]


def test_templates_without_labels_are_no_bridge(spark):
    """Two branches stay apart whatever unlabelled sibling stands between them; with one branch, it joins."""
    rows = [("h", ["a", "p"], 100, 50, 12), ("h", ["a", "q"], 100, 50, 38), ("h", ["a", "r"], 9, 0, 0), ("h", ["b", "p"], 100, 50, 40), ("h", ["b", "r"], 9, 0, 0), ("i", ["a"], 1, 0, 0), ("i", ["a", "a", "a", "a", "a", "b"], 60, 30, 10)]
    found = spark.createDataFrame(rows, "host string, template array<string>, pages long, labelled long, bad long")
    got = {(r["host"], *r["template"]): r for r in url_templates.branches(found).collect()}
    assert len(got) == len(rows)
    assert len({got["h", "a", x]["branch"] for x in "pqr"}) == 3 and got["h", "a", "r"]["known"] == 0
    assert got["h", "b", "r"]["branch"] == got["h", "b", "p"]["branch"] and got["h", "b", "r"]["known"] == 50


def test_templates_of_deep_paths(spark):
    """Levels have no bound: slugs in the ninth segment become a wildcard as they do in the second."""
    deep = "/".join("abcdefgh")
    pages = spark.createDataFrame([(i, f"https://x.fr/{deep}/slug-{chr(97 + i % 26)}{chr(97 + i // 26)}/end") for i in range(300)] + [(None, "https://x.fr/" + "s/" * 300)], "page_id long, url string")
    got = url_templates.judged(pages, spark.createDataFrame([(1, True)], "page long, bad boolean")).collect()
    assert len(got) == 301 and {r["template"] for r in got if r["page_id"] is not None} == {f"/{deep}/*/end"}


def brute_pair(chosen, rejected):
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1

    def render(turns):
        text, spans = "", []
        for role, body in turns:
            text += f"<|{role or ''}|>\n"
            start = len(text)
            text += (body or "") + "<|end|>\n"
            if role == "assistant":
                spans.append((start, len(text)))
        return text, spans

    (a, a_spans), (b, b_spans) = render(chosen[n:]), render(rejected[n:])
    return render(chosen[:n])[0], n, a, b, a_spans, b_spans


def test_preferences(spark):
    rng = random.Random(4)
    long = "é🙂 " * 20_000

    def talk(n, seed):
        r = random.Random(seed)
        return [(r.choice(["user", "assistant", "system", None]), r.choice(["a", "b", "", None, "é🙂"])) for _ in range(n)]

    chosen = {i: talk(rng.randint(0, 6), i % 5) for i in range(40)} | {98: [("user", "q"), ("assistant", long)]}
    rejected = {i: talk(rng.randint(0, 6), i % 7) for i in range(40)} | {98: [("user", "q"), ("assistant", "no")], 99: [("user", "alone")]}
    frame = lambda d: spark.createDataFrame([(k, n, role, text, "x") for k, turns in d.items() for n, (role, text) in enumerate(turns)], "conv_id long, turn int, role string, text string, key string").repartition(3)
    got = {r["key"]: r for r in preferences.preference_rows(frame(chosen), frame(rejected)).collect()}
    want = {k: brute_pair(chosen[k], rejected[k]) for k in chosen if chosen[k] and rejected.get(k)}
    assert got.keys() == want.keys()
    for k, (prompt, n, a, b, a_spans, b_spans) in want.items():
        r = got[k]
        assert (r["prompt"], r["prompt_turns"], r["chosen"], r["rejected"]) == (prompt, n, a, b)
        assert [tuple(s) for s in r["chosen_mask"]] == a_spans and [tuple(s) for s in r["rejected_mask"]] == b_spans
        assert all(a[s:e].endswith("<|end|>\n") for s, e in a_spans)
    empty = frame(chosen).limit(0)
    assert preferences.preference_rows(empty, empty).collect() == []
    twice = frame(chosen).union(frame(chosen))
    assert preferences.preference_rows(twice, twice).where("chosen <> '' OR rejected <> ''").count() == 0


def test_variants(spark, monkeypatch):
    """Pairs of a table of conversations, by brute force: prefixes of all lengths, none without answer or conversation."""
    from kontor.llm import fingerprints

    rng, rows = random.Random(8), [(None, 0, "assistant", "nobody's")]
    for key in rng.sample(range(500), 80):
        rows += [(key, n, rng.choice(["user", "assistant", "system", None]), rng.choice(["a", "b", "", None, "é🙂"])) for n in range(rng.randint(1, 7))]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn int, role string, text string, key string").repartition(3)
    talks = {}
    for key, _, role, text in rows[1:]:
        talks.setdefault(key, []).append((role, text))
    keys = sorted(k for k, t in talks.items() if any(role == "assistant" for role, _ in t))
    want = {}
    for key, after in zip(keys, [*keys[1:], keys[0]]):
        places = [i for i, (role, _) in enumerate(talks[key]) if role == "assistant"]
        first = next(i for i, (role, _) in enumerate(talks[after]) if role == "assistant")
        want[key] = brute_pair(talks[key], talks[key][: places[key % len(places)]] + talks[after][first:])
    for size in (1000, 3):
        monkeypatch.setattr(fingerprints, "RANGE_ROWS", size)
        got = {r["key"]: r for r in preferences.formatted(preferences.variants(turns)).collect()}
        assert got.keys() == want.keys() and len({w[1] for w in want.values()}) > 3
        for k, (prompt, n, a, b, a_spans, b_spans) in want.items():
            r = got[k]
            assert (r["prompt"], r["prompt_turns"], r["chosen"], r["rejected"]) == (prompt, n, a, b)
            assert [tuple(s) for s in r["chosen_mask"]] == a_spans and [tuple(s) for s in r["rejected_mask"]] == b_spans
    assert preferences.variants(turns.limit(0)).collect() == []


def test_preferences_stay_in_spark(spark):
    turns = spark.createDataFrame([(1, 0, "user", "q")], "conv_id long, turn int, role string, text string")
    plan = preferences.formatted(preferences.variants(turns))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
