"""The near-duplicate stage of the pipeline against all pairs of shingle sets."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kontor.llm import near_copies, simhash


def brute_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(rows):
    """Of rows (id, text) with unique ids: the least id of each component."""
    sets = {i: brute_shingles(t) for i, t in rows}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
                low, high = sorted((root(i), root(j)))
                label[high] = low
    return {root(i) for i in sets}


def kept(spark, docs):
    return {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").select("doc_id").collect()}


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_stage_is_all_pairs(spark, size):
    docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet")
    assert kept(spark, docs) == brute_kept([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def test_stage_takes_out_what_four_bits_leave(spark):
    """Copies with changed words, at similarities on both sides of 0.8, and a group that fills long lists."""
    rng = random.Random(3)
    rows = []
    for _ in range(30):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(250)]
        changed = base[:]
        for at in rng.sample(range(250), rng.randint(3, 7)):
            changed[at] = "changed"
        rows += [base, changed]
    base = [f"g{rng.randint(0, 5000)}" for _ in range(200)]
    for _ in range(120):
        row = base[:]
        for at in rng.sample(range(200), rng.randint(0, 5)):
            row[at] = f"x{rng.randint(0, 5000)}"
        rows.append(row)
    rows = [(i, " ".join(words)) for i, words in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_kept(rows)
    assert kept(spark, docs) == want
    assert {r["doc_id"] for r in simhash.one_of_each(docs).collect()} != want


def test_members_far_from_the_middle_of_a_group(spark):
    """Members that the middle does not reach link by what they share with each other; the bound by slots loses none."""
    rng = random.Random(5)
    base = [f"g{rng.randint(0, 5000)}" for _ in range(150)]

    def changed(words, times):
        row = words[:]
        for at in rng.sample(range(len(words)), times):
            row[at] = f"x{rng.randint(0, 30)}"
        return row

    rows = [changed(base, rng.randint(0, 9)) for _ in range(120)]
    rows += [changed(row, 2) for row in rows[::3]]
    rows = [(i, " ".join(words)) for i, words in enumerate(rows)]
    want = brute_kept(rows)
    assert 3 < len(want) < len(rows) / 2
    assert kept(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == want


def test_stage_of_odd_tables(spark, docs, no_docs, texts):
    assert corpus_pipeline.drop_near_duplicates(spark, no_docs, "").collect() == []
    assert kept(spark, docs) == brute_kept([(3 * i, t) for i, t in enumerate(texts)])
    rows = docs.where("doc_id < 30").withColumn("doc_id", F.when(F.col("doc_id") == 15, None).otherwise(F.col("doc_id")))
    found = corpus_pipeline.drop_near_duplicates(spark, rows.union(rows), "")
    assert found.columns == docs.columns
    ids = [r["doc_id"] for r in found.collect()]
    assert len(ids) == len(set(ids)) and None in ids


@pytest.mark.parametrize("one_of_each", [simhash.one_of_each, near_copies.one_of_each])
def test_rows_that_share_a_key_or_have_none(spark, one_of_each):
    rng = random.Random(4)
    a, b, c = (" ".join(f"w{rng.randint(0, 5000)}" for _ in range(250)) for _ in range(3))
    rows = [(1, a), (1, b), (2, b.upper()), (None, c), (None, c.upper()), (None, a.upper())]
    found = one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["text"].lower() for r in found) == sorted([a, b, c])
    assert sorted((r["text"] for r in found if r["doc_id"] == 1)) == sorted([a, b])



def test_wide_simhashes_are_counted_bit_by_bit():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 64, k, np.uint64)) for k in (1, 0, 4, 255, 256, 700, 0)]
    for found, got in zip(sets, near_copies.simhashes(sets)):
        hashes = (found ^ near_copies._MIX[0]) * near_copies._MIX[1]
        hashes ^= hashes >> np.uint64(32)
        bits = [(hashes >> np.uint64(i) & np.uint64(1)).sum(axis=1) for i in range(64)]
        want = [[2 * bits[i][w] > len(found) for i in range(64)] for w in range(near_copies.BYTES // 8)]
        assert np.array_equal(np.packbits(want, axis=1, bitorder="little").reshape(-1), got)


@pytest.mark.parametrize("n", [9, 45, 450])
def test_positional_bytes_reach_the_similarity(n):
    """Sets at a similarity of 0.8 share a list, and enough bytes and bits; others do not share enough."""
    rng = np.random.default_rng(n)
    made = [rng.integers(0, 1 << 64, 2 * n, np.uint64) for _ in range(400)]
    a, b = (near_copies.simhashes([x[at : at + n] for x in made]) for at in (0, n // 9))
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(range(400)), *(pa.array([x.tobytes() for x in p], pa.binary()) for p in (a, b))], names=list("abxy"))
    assert (near_copies.list_keys(a) == near_copies.list_keys(b)).any(axis=1).all()
    assert near_copies._close(list(near_copies._heads(np.concatenate([a, b]))), np.arange(400), np.arange(400, 800)).all()
    (found,) = near_copies._tallied([batch])
    assert found.column(0).to_pylist() == list(range(400))
    (found,) = near_copies._tallied([batch.set_column(2, "x", batch.column(2).take(pa.array(range(399, -1, -1))))])
    assert found.num_rows == 0


@pytest.mark.parametrize("n", [45, 200])
def test_sets_that_share_little_are_no_candidates(n):
    """Of sets at a similarity of 0.25, few agree in the bits that go into the lists; of those at 0.8 of 4 and 5 shingles, all."""
    rng = np.random.default_rng(n)
    made = [rng.integers(0, 1 << 64, 2 * n, np.uint64) for _ in range(400)]
    few = [rng.integers(0, 1 << 64, 5, np.uint64) for _ in range(2000)]

    def close(a, b):
        heads = near_copies._heads(near_copies.simhashes(a + b))
        return near_copies._close(list(heads), np.arange(len(a)), np.arange(len(a), 2 * len(a)))

    assert close([x[:n] for x in made], [x[n * 3 // 5 : n * 3 // 5 + n] for x in made]).mean() < 0.1
    assert close([x[:4] for x in few], few).all()


def test_lists_of_the_index():
    """A sparse list gives all its candidates; a dense one fewer than all, which connect its members, who are named."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 64, 300, np.uint64)
    sets = [np.sort(np.append(base[i : i + 250], rng.integers(0, 1 << 64, 3, np.uint64))) for i in range(40)]
    sets += [rng.integers(0, 1 << 64, 253, np.uint64) for _ in range(200)]
    heads = near_copies._heads(near_copies.simhashes(sets))
    n = np.array([len(x) for x in sets], np.int32)
    close = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if near_copies._close(list(heads), i, j)}
    for rows, dense in ((np.r_[0:3, 40:240], False), (np.arange(40), True)):
        found = near_copies._first(np.full(len(rows), 7, np.int32), rows, n[rows], *np.ascontiguousarray(heads[:, rows])).to_pylist()
        own = {(i, j) for i, j in close if i in rows and j in rows}
        pairs = {tuple(sorted((r["a"], r["b"]))) for r in found if r["b"] is not None}
        members = [r["a"] for r in found if r["key"] == 7]
        assert pairs <= own and len(members) == len(set(members))
        if not dense:
            assert pairs == own and not members
            continue
        seen = {min(rows)}
        while more := {x for p in pairs if set(p) & seen for x in p} - seen:
            seen |= more
        assert len(pairs) < len(own) and seen == set(members) == {x for p in own for x in p}
