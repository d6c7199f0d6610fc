"""Token counts (operator 10): an exact histogram of lengths, and suffix sums over it.

Documents are counted by encoded length where their text is read; the histogram is combined in the map before it is
shuffled, so that what travels is one row for each length and task. Running sums from both ends then answer, for every
length L taken as context limit: how many documents reach it, how many tokens they hold, and how many tokens are left
when every document is cut at L. Buckets of lengths keep any one task's part small.

Lengths are those of byte-level BPE; each worker remembers the counts of up to CACHE_WORDS pre-tokens.

Defined results: a null or empty text has length 0; repeated rows count as often as they occur; an empty table has an
empty histogram; columns other than the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kontor.llm import pretokens, scratch
from kontor.llm.bpe import vocabulary_path, word_encoder
from kontor.llm.prefix import sums_before

CACHE_WORDS = 1_000_000
#: Lengths of a bucket.
BUCKET = 128


class WordCounts(dict):
    """From a pre-token to the number of its ids."""

    def __init__(self, path: str):
        self.encode = word_encoder(path).encode_ordinary

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self.encode(word))
        return n

    def count(self, text: str) -> int:
        n = sum(map(self.__getitem__, pretokens.split_bytelevel(text)))
        if len(self) > CACHE_WORDS:
            self.clear()
        return n


@cache
def word_counts(path: str) -> WordCounts:
    return WordCounts(path)


def lengths(docs: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(n_tokens) for every row."""
    scratch.small_batches(docs.sparkSession)
    vocabulary = vocabulary or vocabulary_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = word_counts(vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([counts.count(x or "") for x in batch.column(0).to_pylist()], pa.int64())], names=["n_tokens"])

    return docs.select(text).mapInArrow(count, "n_tokens long")


def histogram(docs: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(n_tokens, docs, tokens): documents of each length, and the tokens in them."""
    counted = lengths(docs, text, vocabulary).groupBy("n_tokens").agg(F.count("*").alias("docs"))
    return counted.withColumn("tokens", F.col("n_tokens") * F.col("docs"))


def curves(hist: DataFrame) -> DataFrame:
    """For each length L: n_tokens (L), docs, docs_below, docs_reaching, tokens_reaching, tokens_cut (left when all are cut at L)."""
    rows = scratch.written(hist.withColumn("bucket", F.expr(f"n_tokens div {BUCKET}")), "lengths")
    order = [F.col("n_tokens")]
    rows = sums_before(rows, [], "bucket", order, "docs", "docs_below")
    rows = sums_before(rows, [], "bucket", order, "tokens", "tokens_below")
    down = [F.col("n_tokens").desc()]
    rows = sums_before(rows, [], "bucket", down, "docs", "docs_above", descending=True)
    rows = sums_before(rows, [], "bucket", down, "tokens", "tokens_above", descending=True)
    reaching = F.col("docs_above") + F.col("docs")
    return rows.select(
        "n_tokens",
        "docs",
        "docs_below",
        reaching.alias("docs_reaching"),
        (F.col("tokens_above") + F.col("tokens")).alias("tokens_reaching"),
        (F.col("tokens_below") + reaching * F.col("n_tokens")).alias("tokens_cut"),
    )


def quantile(found: DataFrame, q: float) -> DataFrame:
    """One row (n_tokens): the least length that a part q of the documents does not exceed."""
    inside = F.col("docs_below") + F.col("docs")
    return found.where(inside >= q * (F.col("docs_below") + F.col("docs_reaching"))).agg(F.min("n_tokens").alias("n_tokens"))


def cut_at(hist: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, tokens_cut) for any limits, also such that no document has as its length."""
    sums = hist.agg(*(F.coalesce(F.sum(F.least(F.col("n_tokens"), F.lit(x)) * F.col("docs")), F.lit(0)).alias(f"_{i}") for i, x in enumerate(limits)))
    pairs = F.array(*(F.struct(F.lit(x).cast("long").alias("limit"), F.col(f"_{i}").alias("tokens_cut")) for i, x in enumerate(limits)))
    return sums.select(F.inline(pairs))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves(histogram(spark.read.parquet(f"{sf_dir}/documents.parquet")))
