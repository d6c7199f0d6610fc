"""Language identification by language-bitmask n-gram filters (operator 8).

A bit-sliced Bloom filter holds, in each slot, one bit for every language. An n-gram's slots, combined by AND, give all
languages that contain it, in a few memory reads however many languages there are. A text's n-grams give one popcount
for each language; each count is corrected by the false positives that the language's slices are filled for, and the
largest corrected share decides.

Fitting takes a bounded sample of labelled rows: about SAMPLE_ROWS of each of the LANGUAGES languages with most rows,
chosen by a hash of key and text (one row of each language at least), whole texts; rows that repeat key and text count once. Every n-gram of the sample goes
in. Each task fills a filter of its own; their bits are combined by slot, so what travels and what reaches the driver is
bounded by the size of the filter, SLOTS x 8 bytes for each 64 languages, as is what is broadcast. Prediction reads every
whole text; it is a narrow stage without any shuffle.

Defined results: `und` with score 0 for null texts, texts without any letter, and where nothing could be learned; ties
go to the language that is first by code point; rows with null text or null language are not learned from; repeated
rows and null keys give a row each; columns other than key, text and language are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kontor.llm import pretokens, scratch

#: Lengths of n-grams, in code points; words are bounded by one space.
LENGTHS = (3, 4, 5)
#: Rows of a language to learn from, on average at most; languages, at most.
SAMPLE_ROWS, LANGUAGES = 2000, 256
#: Slots of the filter (a power of two) and hashes of an n-gram.
SLOTS, HASHES = 1 << 20, 3
#: Code points handled at once; results do not depend on it.
PIECE = 1 << 17

_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


@dataclass
class Filter:
    """languages by code point; slots[w] holds the bits of languages 64 w to 64 w + 63; wrong[l]: chance of a false positive."""

    languages: list[str]
    slots: np.ndarray
    wrong: np.ndarray


def grams(text: str) -> Iterator[np.ndarray]:
    """Hashes of the text's n-grams, piece by piece: lower case, letters only, anything else one space, words bounded by one.

    What a piece ends with is carried into the next, so that pieces change nothing.
    """
    kinds, lower = pretokens.classes(), text.lower()
    carried, after_letter = np.array([32], np.uint64), False
    for at in range(0, len(lower), PIECE):
        points = np.frombuffer((lower[at : at + PIECE] + " " * (at + PIECE >= len(lower))).encode("utf-32-le", "surrogatepass"), "<u4")
        letter = kinds[points] == pretokens.LETTER
        keep = letter | np.concatenate(([after_letter], letter[:-1]))  # of other signs in a row, the first
        after_letter = bool(letter[-1])
        new = np.where(letter, points, 32)[keep].astype(np.uint64)
        row = np.concatenate((carried, new))
        for n in LENGTHS:
            own = row[max(0, len(carried) - n + 1) :]
            if len(new) and len(own) >= n:
                h = np.full(len(own) - n + 1, n, np.uint64)
                for i in range(n):
                    h = (h ^ own[i : len(own) - n + 1 + i]) * _MIX[0]
                    h ^= h >> np.uint64(29)
                yield h
        carried = row[-max(LENGTHS) + 1 :]


def _slots(h: np.ndarray) -> list[np.ndarray]:
    return [((h * m) >> np.uint64(40)).astype(np.int64) & (SLOTS - 1) for m in _MIX[:HASHES]]


def held_out(key: Column) -> Column:
    """Rows that are never learned from: crc32 of the key as text divides by 5."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def empty_slots(languages: int) -> np.ndarray:
    return np.zeros((max(1, -(-languages // 64)), SLOTS), np.uint64)


def learn(text: str, language: int, slots: np.ndarray) -> None:
    """Puts all n-grams of a text in."""
    bit = np.uint64(1 << (language % 64))
    for h in grams(text):
        for at in _slots(h):
            slots[language // 64, at] |= bit


def sampled(docs: DataFrame, key: str, text: str, lang: str) -> tuple[list[str], DataFrame | None]:
    """The languages, and (lang, text) of the rows to learn from."""
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & ~held_out(F.col(key)))
    mark = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), F.col(key).cast("string"), F.col(text)), 11) * F.lit(2.0**-53)
    rows = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"), mark.alias("mark"))
    found = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("mark").alias("least")).orderBy(F.col("n").desc(), "lang").limit(LANGUAGES).collect()
    if not found:
        return [], None
    # The least mark of a language is always in.
    limit = F.create_map(*(F.lit(x) for r in found for x in (r["lang"], max(r["least"], SAMPLE_ROWS / r["n"]))))
    rows = rows.where(F.col("mark") <= F.element_at(limit, F.col("lang")))
    return sorted(r["lang"] for r in found), rows.groupBy("lang", "mark").agg(F.min("text").alias("text")).select("lang", "text")


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Filter:
    """Learns the filter from the labelled rows that are not held out."""
    scratch.small_batches(docs.sparkSession)
    languages, sample = sampled(docs, key, text, lang)
    slots = empty_slots(len(languages))
    if sample is None:
        return Filter([], slots, np.zeros(0))
    place = {name: i for i, name in enumerate(languages)}

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = empty_slots(len(languages))
        for batch in batches:
            for name, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                learn(x, place[name], own)
        for w, row in enumerate(own):
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), w)), pa.array(at), pa.array(row[at].view(np.int64))], names=["word", "slot", "bits"])

    filled = sample.mapInArrow(fill, "word long, slot long, bits long").groupBy("word", "slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    slots[filled["word"].to_numpy(), filled["slot"].to_numpy()] = filled["bits"].to_numpy().view(np.uint64)
    full = [((slots[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))]
    return Filter(languages, slots, np.array(full) ** HASHES)


def judge(text: str | None, model: Filter) -> tuple[str, float]:
    """The language of a text and the part of its n-grams that the language contains, corrected."""
    n = len(model.languages)
    total, hits = 0, np.zeros(n, np.int64)
    for h in grams(text or "") if n else ():
        at = _slots(h)
        total += len(h)
        for w, slots in enumerate(model.slots):
            mask = slots[at[0]]
            for x in at[1:]:
                mask &= slots[x]
            own = min(64, n - 64 * w)
            planes = mask.view(np.uint8).reshape(-1, 8)[:, : -(-own // 8)]
            hits[64 * w : 64 * w + own] += np.unpackbits(planes, axis=1, bitorder="little")[:, :own].sum(axis=0, dtype=np.int64)
    if not total:
        return "und", 0.0
    share = np.clip((hits / total - model.wrong) / np.maximum(1 - model.wrong, 1e-9), 0, 1)
    best = int(share.argmax())
    return model.languages[best], float(share[best])


def predict(docs: DataFrame, model: Filter, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) for every row."""
    scratch.small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judge(x, sent.value) for x in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "lang_pred", "score"])

    schema = T.StructType([docs.schema[key], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(key, text).mapInArrow(judged, schema)


def identified(docs: DataFrame, model: Filter, text: str = "text", least: float = 0.2) -> DataFrame:
    """The rows of `docs` whose language is known: not `und`, and with a score of `least` or more. All columns stay."""
    scratch.small_batches(docs.sparkSession)
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judge(x, sent.value) for x in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([name != "und" and score >= least for name, score in found], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predict(docs, fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
