"""Operators 3, 9 and 10: token files, byte-level BPE, token counts."""

import base64
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kontor.llm import bpe, dac, lengths, pretokens, scratch


@pytest.fixture(scope="module")
def library():
    import public_tokenizers as P
    import tiktoken

    with open(bpe.vocabulary_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def words():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(dac.vocabulary_path())


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab 'strevmld\t\n\r 12\u0663½é̈字—!?\x1c\x85\u200bΣİ"), st.characters(exclude_categories=["Cs"])), max_size=30))
def test_splits_are_the_patterns(text):
    import public_tokenizers as P
    import regex

    assert pretokens.split_bytelevel(text) == regex.findall(P.PATTERN, text)
    assert pretokens.split_words(text) == regex.findall(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", text)


def test_byte_bpe_is_the_library(docs, texts, library, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_TOKENS", 50)  # many blocks, so that words meet again
    got = {r["doc_id"]: r for r in bpe.decode(bpe.encode(docs)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        assert got[3 * i]["token_ids"] == library.encode_ordinary(text or "")
        assert bytes(got[3 * i]["decoded"]).decode() == (text or "")


def test_byte_bpe_of_odd_tables(spark, docs, no_docs):
    assert bpe.encode(no_docs).collect() == []
    twice = bpe.encode(docs.where("doc_id = 12").union(docs.where("doc_id = 12")).withColumn("doc_id", F.lit(None).cast("long")))
    assert [r["doc_id"] for r in twice.collect()] == [None, None]
    assert bpe.digests(bpe.decode(bpe.encode(docs.where("text IS NULL")))).first()["n_tokens"] == 0


def test_words_of_every_character_are_the_library(words):
    """All assigned code points (others go to the library) but private ones, alone and in context; texts of many at once, too."""
    import unicodedata

    encoder = dac.word_encoder(dac.vocabulary_path())
    points = [c for c in map(chr, range(0x30000)) if unicodedata.category(c) not in ("Cn", "Cs", "Co") and not 0x3400 < ord(c) < 0x9000 and not 0xAC00 < ord(c) < 0xD700 and not 0x20000 < ord(c)]
    texts = [f"a<{c}>b 1<{c}> '{c}S {c}" for c in points] + ["".join(points[i : i + 50]) for i in range(0, len(points), 50)]
    for at in range(0, len(texts), 50_000):
        part = texts[at : at + 50_000]
        for text, want in zip(part, words.encode_batch(part, add_special_tokens=False)):
            assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want.ids, ascii(text)
    assert 100 < len(encoder.other) < 5000 and all(dac.WordEncoder(dac.vocabulary_path())._own(t) for t in ("Ça va? Grüße", "漢字", "İx Σας 🙂"))


def test_codes_give_every_id():
    rng = random.Random(3)
    for n in (0, 1, 511, 512, 513, 3000):
        ids = np.array([rng.choice([rng.randrange(256), rng.randrange(65536), rng.randrange(1 << 32)]) for _ in range(n)], np.uint32)
        cut = n // 3
        f = dac.DacFile(dac.pack([7, None], np.array([cut, n - cut]), ids))
        assert f.ids().tolist() == ids.tolist() and f.keys == [7, None]
        assert f.document(0).tolist() == ids[:cut].tolist() and f.document(1).tolist() == ids[cut:].tolist()
        assert all(f.get(i) == ids[i] for i in rng.sample(range(n), min(n, 200)))
        for _ in range(20):
            a, b = sorted((rng.randint(0, n), rng.randint(0, n)))
            assert f.ids(a, b).tolist() == ids[a:b].tolist()
        with pytest.raises(IndexError):
            f.get(n)


def test_token_files_are_the_library(spark, docs, texts, words, monkeypatch):
    folder = scratch.new_path(spark, "test")
    manifest = dac.write_files(docs, folder)
    got = dac.read_files(spark, folder, manifest).orderBy("doc_id").collect()
    start = 0
    for row, text in zip(got, texts, strict=True):
        ids = words.encode(text or "", add_special_tokens=False).ids + [1]
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), text
        start += len(ids)
    assert manifest.agg(F.sum("tokens")).first()[0] == start


def test_token_files_of_odd_tables(spark, docs, no_docs):
    folder = scratch.new_path(spark, "test")
    assert dac.read_files(spark, folder, dac.write_files(no_docs, folder)).collect() == []
    rows = docs.where("doc_id IN (9, 12)").withColumn("doc_id", F.when(F.col("doc_id") == 9, None).otherwise(F.col("doc_id")))
    folder = scratch.new_path(spark, "test")
    got = dac.read_files(spark, folder, dac.write_files(rows.union(rows), folder)).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, 12, 12] and [r["start"] for r in got] == [0, 2, 4, 6]


def test_token_counts(docs, no_docs, texts, library):
    n = np.array([len(library.encode_ordinary(t or "")) for t in texts])
    hist = lengths.histogram(docs)
    found = lengths.curves(hist)
    rows = found.collect()
    assert sorted(r["n_tokens"] for r in rows) == sorted(set(n.tolist()))
    for r in rows:
        at = r["n_tokens"]
        assert r["docs"] == (n == at).sum() and r["docs_below"] == (n < at).sum() and r["docs_reaching"] == (n >= at).sum()
        assert r["tokens_reaching"] == n[n >= at].sum() and r["tokens_cut"] == np.minimum(n, at).sum()
    assert lengths.quantile(found, 0.5).first()[0] == sorted(n)[-(-len(n) // 2) - 1]
    assert {r["limit"]: r["tokens_cut"] for r in lengths.cut_at(hist, [0, 17, 1 << 40]).collect()} == {x: int(np.minimum(n, x).sum()) for x in (0, 17, 1 << 40)}
    assert lengths.curves(lengths.histogram(no_docs)).collect() == []
