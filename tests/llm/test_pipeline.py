"""The pipeline and the registered queries against brute force and SQL, on the smallest tables."""

import base64
import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kontor.llm import bpe, langid, mixing, scratch
from kontor.llm import queries as Q
from tests.llm.test_documents import brute_targets
from tests.llm.test_near_copies import brute_kept

SF = "/root/testdata/sf0.001"


def brute_pipeline(rows, model):
    """Rows (doc_id, text, source, ...) through the four stages, one document at a time."""
    import public_tokenizers as P
    import tiktoken

    rows = [r for r in rows if (found := langid.judge(r["text"], model))[0] != "und" and found[1] >= 0.2]
    least = brute_kept([(r["doc_id"], r["text"]) for r in rows])
    rows = [r for r in rows if r["doc_id"] in least]
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in rows}
    whole = Counter()
    for r in rows:
        whole[r["source"]] += size[r["doc_id"]]
    target, before, copies = brute_targets(whole), Counter(), {}
    for r in sorted(rows, key=lambda r: hashlib.md5(f"{r['doc_id']} {hashlib.md5(r['text'].encode()).hexdigest()}".encode()).hexdigest()):
        s, n = r["source"], size[r["doc_id"]]
        copies[r["doc_id"]] = sum(2 * (before[s] + lap * whole[s]) + n <= 2 * target[s] for lap in range(2))
        before[s] += n
    with open(bpe.vocabulary_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Counter({(r["doc_id"], tuple(encoder.encode_ordinary(r["text"]))): copies[r["doc_id"]] for r in rows if copies[r["doc_id"]]})


def test_pipeline_is_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = Counter((r["doc_id"], tuple(r["token_ids"])) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == brute_pipeline([r.asDict() for r in docs.collect()], langid.fit(docs))
    assert len(got) > 50 and 2 in got.values()


def test_stages_return_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).schema.names == docs.schema.names, name
    assert len(corpus_pipeline.STAGES) == 4


def test_training_order(spark, docs):
    """Rows lie in the order of their positions, and the pipeline delivers them in it."""
    plan = mixing.mix(docs).collect()
    rows = [r["doc_id"] for r in mixing.arranged(docs).collect()]
    place = sorted((p, r["doc_id"]) for r in plan for p in r["positions"])
    assert len({p for p, _ in place}) == len(place) and rows == [k for _, k in place]
    table = scratch.written(mixing.arranged(docs), "mixture")
    found = corpus_pipeline.encode_tokens(spark, table, "").collect()
    assert [r["doc_id"] for r in found] == rows and all(r["exact"] for r in found)
    assert sorted(r["position"] for r in found) == [r["position"] for r in found] and len({r["position"] for r in found}) == len(rows)


def test_pipeline_of_odd_tables(spark, docs, no_docs, tmp_path):
    """Null ids and texts, repeats, very long texts, extra columns with clashing names; and nothing at all."""
    rows = docs.withColumn("doc_id", F.when(F.col("doc_id") % 4 == 0, None).otherwise(F.col("doc_id")))
    rows.union(rows).withColumn("position", F.lit("own")).write.parquet(str(tmp_path / "a" / "documents.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path / "a")).collect()
    assert found and all(r["exact"] for r in found) and any(r["doc_id"] is None for r in found)
    no_docs.write.parquet(str(tmp_path / "b" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).collect() == []


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_queries_are_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = Q.QUERIES[name](spark, SF)
    want = con.execute(Q.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    plain = lambda rows: sorted(tuple(str(r[c]) for c in columns) for r in rows)
    assert plain([r.asDict() for r in got.collect()]) == plain(want.to_dict("records"))


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE_SQL)))
def test_other_queries_give_every_row(spark, name):
    n = Q.QUERIES[name](spark, SF).count()
    assert n > 0
    if name != "op10_token_counts":
        assert n == spark.read.parquet(f"{SF}/documents.parquet").count()
