"""Operators 1, 6, 7 and 8: fingerprints, SimHash, mixing, language."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kontor.llm import components, fingerprints, langid, mixing, simhash


def jaccard(a, b):
    a, b = Counter(re.findall(r"[^\x20\x09-\x0D]+", a)), Counter(re.findall(r"[^\x20\x09-\x0D]+", b))
    most = sum((a | b).values())
    return sum((a & b).values()) / most if most else 1.0


def brute_sample(text, samples):
    """Consistent weighted sampling word by word, with Python's own hashes and logarithms."""
    import xxhash

    def chained(word, x):
        return xxhash.xxh64_intdigest(np.int32(x).tobytes(), xxhash.xxh64_intdigest(np.int64(word).tobytes(), 42))

    counts = Counter(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    words = {np.uint64(xxhash.xxh64_intdigest(w.encode(), 42)).view(np.int64): n for w, n in counts.items()}
    out = []
    for k in range(samples):
        best = None
        for word, n in words.items():
            one, two = chained(word, 2 * k), chained(word, 2 * k + 1)
            u = lambda bits, width: ((bits & ((1 << width) - 1)) + 0.5) * 2.0**-width
            r = -np.log(u(one, 32) * u(one >> 32, 32))
            t = int(np.floor(np.log(n) / r + u(two >> 48, 16)))
            a = np.log(-np.log(u(two, 24) * u(two >> 24, 24))) - r * (t + 1 - u(two >> 48, 16))
            name = ((int(word) % (1 << 64) >> (k % 40)) ^ t) & ((1 << 24) - 1)
            best = min(best or (np.inf, 0), (a, name))
        out.append(f"{best[1]:06x}" if best else "000000")
    return out


def test_fingerprints(docs, texts):
    """At the registered number of samples: each is that of brute force, and likeness estimates the similarity."""
    n = fingerprints.SAMPLES
    got = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(docs).collect()}
    plain, errors, same, equal = [t or "" for t in texts], [], defaultdict(set), []
    for i, text in enumerate(plain):
        row, after = got[3 * i], plain[i - 1]  # by descending id; after the last, the first
        m = len(text) // 3
        edited = text[: len(text) - m] + after[:m]
        assert row["n_chars"] == len(text) and row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        errors += [row["near_edited"] - jaccard(text, edited), row["near_next"] - jaccard(text, after)]
        same[text].add(row["fingerprint"])
        for x, side in ((text, "fingerprint"), (edited, "edited_fingerprint")):
            equal += [a == row[side][6 * k : 6 * k + 6] for k, a in enumerate(brute_sample(x, n))]
        assert row["near_edited"] == sum(row["fingerprint"][6 * k : 6 * k + 6] == row["edited_fingerprint"][6 * k : 6 * k + 6] for k in range(n)) / n
    assert np.mean(equal) > 0.999  # the last bit of a logarithm may differ
    assert abs(np.mean(errors)) < 0.03 and np.sqrt(np.mean(np.square(errors))) < 0.09
    assert all(len(s) == 1 for s in same.values())


def test_fingerprints_of_hot_keys(docs, monkeypatch):
    """A key, or none, that holds a third of all rows is dealt by text; results do not depend on the ranges."""
    rows = docs.where("doc_id > 15").withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, 60).when(F.col("doc_id") % 5 == 0, None).otherwise(F.col("doc_id")))
    one = Counter(fingerprints.edited_fingerprints(rows).collect())
    for size, bounds in ((2, 128), (2, 2), (5, 3)):
        monkeypatch.setattr(fingerprints, "RANGE_ROWS", size)
        monkeypatch.setattr(fingerprints, "BOUNDS", bounds)
        assert Counter(fingerprints.edited_fingerprints(rows).collect()) == one
    assert fingerprints.ranges(rows.select("doc_id"), "doc_id")[1][60] > 1


def test_fingerprints_in_many_ranges(docs, texts, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 5)
    one = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(docs).collect()}
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 1000)
    assert one == {r["doc_id"]: r for r in fingerprints.edited_fingerprints(docs).collect()}


def test_fingerprints_of_odd_tables(docs, no_docs):
    assert fingerprints.edited_fingerprints(no_docs).collect() == []
    single = fingerprints.edited_fingerprints(docs.where("doc_id = 30")).first()
    assert single["near_next"] == 1.0
    rows = docs.where("doc_id < 12").withColumn("doc_id", F.when(F.col("doc_id") < 6, None).otherwise(F.col("doc_id")))
    assert fingerprints.edited_fingerprints(rows.union(rows)).count() == 8
    empty = fingerprints.edited_fingerprints(docs.where("doc_id < 9")).collect()
    assert {r["fingerprint"] for r in empty} == {"0" * 6 * fingerprints.SAMPLES} and all(r["near_next"] == 1 for r in empty)


def test_fingerprints_stay_in_spark(docs):
    plan = fingerprints.fingerprints(docs, ["doc_id"], "text")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange hashpartitioning(text" not in plan


def brute_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints, bits=4):
    label = dict(zip(ids, ids))
    changed = True
    while changed:
        changed = False
        for i, a in zip(ids, prints):
            for j, b in zip(ids, prints):
                if bin(a ^ b).count("1") <= bits and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def test_simhash(docs, texts):
    prints = [brute_fingerprint(t) for t in texts]
    want = brute_components([3 * i for i in range(len(texts))], prints)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert {k: r["fp"] % (1 << 64) for k, r in got.items()} == {3 * i: p for i, p in enumerate(prints)}
    assert {k: r["component"] for k, r in got.items()} == want
    kept = {r["doc_id"] for r in simhash.one_of_each(docs).collect()}
    assert kept == set(want.values())


def test_simhash_triples_cover_all_fours():
    from itertools import combinations

    triples = list(map(set, simhash.position_triples()))
    assert len(triples) == 20 and all(any(t <= set(four) for t in triples) for four in combinations(range(8), 4))


def test_simhash_links_of_many(spark):
    """Chains, stars and noise: the components are those of all pairs."""
    rng = np.random.default_rng(5)
    prints = list(map(int, rng.integers(0, 1 << 63, 200, dtype=np.int64)))
    centre = prints[0]
    star = [centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, (300, 2))]
    chain = [prints[1]]
    for _ in range(40):
        for b in rng.choice(63, 4, replace=False):
            chain.append(chain[-1] ^ (1 << int(b)))
    every = sorted(set(prints + star + chain))
    want = brute_components(every, every)
    links = simhash.link_fingerprints(spark.createDataFrame([(x,) for x in every], "fp long").repartition(3))
    got = {r["node"]: r["label"] for r in components.components(links, "a", "b").collect()}
    assert {x: got.get(x, x) for x in every} == want
    assert links.count() < 25 * len(every)  # a forest for each list, not all pairs


def test_simhash_splits_long_lists(spark, monkeypatch):
    """A list split by a fourth byte gives the links of all pairs."""
    rng = np.random.default_rng(6)
    monkeypatch.setattr(simhash, "LONG", 40)
    prints = {int(x) for x in rng.integers(0, 1 << 39, 150)}  # three bytes are those of all
    prints |= {x ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) ^ (1 << int(d)) for x in list(prints)[:60] for a, b, c, d in [rng.choice(39, 4, replace=False)]}
    every = sorted(prints)
    links = simhash.link_fingerprints(spark.createDataFrame([(x,) for x in every], "fp long"))
    got = {r["node"]: r["label"] for r in components.components(links, "a", "b").collect()}
    assert {x: got.get(x, x) for x in every} == brute_components(every, every)


@pytest.mark.parametrize("order", ["ascending", "random", "outside in", "halves"])
def test_components_of_a_long_path(spark, monkeypatch, order):
    n, calls = 10_000, []
    places = {
        "ascending": list(range(n)),
        "random": np.random.default_rng(1).permutation(n).tolist(),
        "outside in": [x for pair in zip(range(n // 2), range(n - 1, n // 2 - 1, -1)) for x in pair],
        "halves": [i // 2 if i % 2 else n // 2 + i // 2 for i in range(n)],
    }[order]
    large = components._large_star
    monkeypatch.setattr(components, "_large_star", lambda edges: calls.append(1) or large(edges))
    found = components.components(spark.createDataFrame(list(zip(places, places[1:])), "a long, b long"), "a", "b").collect()
    assert len(found) == n and {r["label"] for r in found} == {0} and len(calls) <= 20


def test_simhash_of_odd_tables(docs, no_docs):
    assert simhash.near_duplicates(no_docs).collect() == [] and simhash.one_of_each(no_docs).collect() == []
    rows = docs.where("doc_id < 30").withColumn("doc_id", F.when(F.col("doc_id") == 15, None).otherwise(F.col("doc_id")))
    kept = simhash.one_of_each(rows.union(rows))
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and None in ids and 0 in ids and 3 not in ids
    with pytest.raises(ValueError):
        simhash.link_fingerprints(docs.select(F.col("size").alias("fp")), bits=5)


def brute_targets(sizes):
    """Water-filling round by round."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {n: mixing.WEIGHTS[i % 3] for i, n in enumerate(names)}
    goal, left, free = {}, 1.5 * sum(sizes.values()), set(names)
    while free:
        share = {n: left * weight[n] / sum(weight[m] for m in free) for n in free}
        full = {n for n in free if share[n] > 2 * sizes[n]}
        if not full:
            return goal | share
        for n in full:
            goal[n] = 2.0 * sizes[n]
            left -= goal[n]
        free -= full
    return goal


def test_mixing(docs, texts):
    got = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    sources = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    total, taken = Counter(), Counter()
    for i, n in enumerate(size):
        row = got[3 * i]
        assert row["size"] == n and row["taken"] in (0, n, 2 * n) and row["taken"] == n * len(row["positions"])
        assert all(0 <= p <= 1 for p in row["positions"]) and row["positions"] == sorted(row["positions"])
        total[sources[3 * i]] += n
        taken[sources[3 * i]] += row["taken"]
    want = brute_targets(total)
    for k, row in got.items():
        assert row["source_size"] == total[sources[k]] and row["target"] == pytest.approx(want[sources[k]])
    for s in total:
        assert abs(taken[s] - want[s]) <= max(size[i] for i in range(len(size)) if sources[3 * i] == s)
    assert got == {r["doc_id"]: r for r in mixing.mix(docs.repartition(7)).collect()}


def test_positions_follow_the_schedule(spark):
    """The part of a source's demand before time t is the integral of its schedule."""
    rows = spark.range(100_001).select((F.col("id") / 100_000).alias("x"))
    for weight, y in zip(mixing.WEIGHTS, mixing.INTENSITY):
        t = np.array([r[0] for r in rows.select(mixing._position(F.col("x"), F.lit(weight))).collect()])
        grid = np.linspace(0, 1, 1001)
        rate = np.interp(grid, mixing.TIMES, y)
        integral = np.concatenate(([0], np.cumsum((rate[1:] + rate[:-1]) / 2))) / 1000
        assert np.allclose(np.interp(t, grid, integral / integral[-1]), np.linspace(0, 1, len(t)), atol=1e-3)


def test_mixing_arranges_rows(docs, no_docs):
    plan = {r["doc_id"]: r["taken"] // max(1, r["size"]) for r in mixing.mix(docs).collect()}
    rows = mixing.arranged(docs)
    assert rows.columns == docs.columns and Counter(r["doc_id"] for r in rows.collect()) == Counter({k: n for k, n in plan.items() if n})
    assert mixing.mix(no_docs).collect() == [] and mixing.arranged(no_docs).collect() == []
    nothing = mixing.mix(docs.where("doc_id < 9")).collect()
    assert all(r["target"] == 0 and r["taken"] == 0 for r in nothing)
    same = docs.where("doc_id = 30")
    assert mixing.mix(same.union(same).union(same)).count() == 3


def test_mixing_takes_rows_without_key_and_repeated_rows(docs):
    """What arranged() gives is what mix() counts, also where keys are null, repeat, or rows are the same."""
    rows = docs.where("doc_id > 30").withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, None).when(F.col("doc_id") % 5 == 0, 7).otherwise(F.col("doc_id")))
    rows = rows.union(rows.where("size % 4 = 0")).union(rows.where("size % 4 = 0"))
    plan, got = mixing.mix(rows).collect(), mixing.arranged(rows).collect()
    assert len(got) == sum(len(r["positions"]) for r in plan) and any(r["doc_id"] is None for r in got)
    taken = Counter((r["doc_id"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))) for r in got)
    want = Counter()
    for r in plan:
        want[r["doc_id"], r["size"]] += len(r["positions"])
    assert taken == +want
    assert got == mixing.arranged(rows.repartition(5)).collect() or Counter(got) == Counter(mixing.arranged(rows.repartition(5)).collect())


@pytest.fixture(scope="module")
def prose(spark):
    rows = [(r * 4 + i, " ".join(words[(r * 7 + 3 * k + k * k) % len(words)] for k in range(30)), lang, None) for r in range(60) for i, (lang, words) in enumerate(PROSE.items())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


PROSE = {
    "en": "the house stands where water runs through many fields while children would often laugh and shout".split(),
    "fr": "une maison blanche près des rivières où les enfants rêvent toujours de longs voyages heureux".split(),
    "de": "das Haus steht zwischen großen Wäldern während Kinder häufig über schöne Geschichten lachen können".split(),
    "es": "la casa pequeña está junto al río donde los niños sueñan siempre con viajes muy largos".split(),
}


def test_language(prose, docs):
    import zlib

    model = langid.fit(prose)
    assert model.languages == ["de", "en", "es", "fr"]
    got = langid.predict(prose, model).join(prose.select("doc_id", "lang", langid.held_out(F.col("doc_id")).alias("out")), "doc_id").collect()
    assert all(r["lang_pred"] == r["lang"] for r in got) and all(0.5 < r["score"] <= 1 for r in got)
    assert all(r["out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got) and any(r["out"] for r in got)
    assert langid.identified(prose, model).count() == prose.count()
    odd = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert len(odd) == docs.count() and {odd[k]["lang_pred"] for k in (0, 3, 6)} == {"und"} and odd[0]["score"] == 0
    assert langid.judge("12 !? 漢", model)[0] in model.languages and langid.judge("12 !?", model) == ("und", 0.0)


def test_language_of_long_texts_is_that_of_pieces(prose, monkeypatch):
    model = langid.fit(prose)
    text = " ".join(PROSE["fr"]) * 50
    whole = langid.judge(text, model)
    assert whole[0] == "fr"
    text = "Σας İx  12 " + text + " ß!"
    every = [np.sort(np.concatenate([*langid.grams(t), np.zeros(0, np.uint64)])) for t in (text, "a", "", " .", "é")]
    for piece in (1, 2, 3, 7, 100, 1 << 20):
        monkeypatch.setattr(langid, "PIECE", piece)
        for t, want in zip((text, "a", "", " .", "é"), every):
            assert np.array_equal(np.sort(np.concatenate([*langid.grams(t), np.zeros(0, np.uint64)])), want)
        assert langid.judge(" ".join(PROSE["fr"]) * 50, model) == whole


def brute_grams(text):
    import regex

    text = regex.sub(r"[^\p{L}]+", " ", f" {text.lower()} ")
    return [text[i : i + n] for n in langid.LENGTHS for i in range(len(text) - n + 1)] if text.strip() else []


def test_language_is_brute_force(prose):
    """Shares by sets of n-grams, without hashes: the filter's are those, corrected."""
    out = {r["doc_id"]: r["out"] for r in prose.select("doc_id", langid.held_out(F.col("doc_id")).alias("out")).collect()}
    rows, held = prose.collect(), defaultdict(set)
    for r in rows:
        if not out[r["doc_id"]]:
            held[r["lang"]] |= set(brute_grams(r["text"]))
    got = {r["doc_id"]: r for r in langid.predict(prose, langid.fit(prose)).collect()}
    for r in rows:
        found = brute_grams(r["text"])
        share = {x: sum(g in held[x] for g in found) / len(found) for x in sorted(held)}
        best = max(sorted(share), key=share.get)
        assert got[r["doc_id"]]["lang_pred"] == best and got[r["doc_id"]]["score"] == pytest.approx(share[best], abs=0.01)


def test_language_learns_from_rows_that_repeat_a_key(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 2)
    for key in (1, None):
        rows = spark.createDataFrame([(key, " ".join(words), lang) for lang, words in PROSE.items()] * 50, "doc_id long, text string, lang string")
        model = langid.fit(rows)
        assert model.languages == sorted(PROSE) and {r["lang_pred"] for r in langid.predict(rows, model).collect()} == set(PROSE)


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.predict(docs, langid.fit(docs)).join(docs.where(langid.held_out(F.col("doc_id"))).select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) / len(found) > 0.98


def test_language_without_labels(prose, no_docs):
    model = langid.fit(prose.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in langid.predict(prose, model).collect()} == {"und"}
    assert langid.predict(no_docs, langid.fit(no_docs)).collect() == []


def test_language_filters_hold_what_was_put_in():
    """No n-gram that a language has is missed; more than 64 languages take another word."""
    h = np.unique(np.random.default_rng(1).integers(0, 1 << 62, 5000).astype(np.uint64))
    slots = np.zeros((2, langid.SLOTS), np.uint64)
    for at in langid._slots(h):
        slots[1, at] |= np.uint64(1 << 3)
    mask = np.bitwise_and.reduce([slots[1][at] for at in langid._slots(h)])
    assert (mask == 8).all()
    other = np.unique(np.random.default_rng(2).integers(0, 1 << 62, 100_000).astype(np.uint64))
    assert (np.bitwise_and.reduce([slots[1][at] for at in langid._slots(other)]) == 8).mean() < 0.01
