"""Document fingerprints by consistent weighted sampling (operator 1). DataFrame functions only.

A document is a bag of words; a word's weight S is its count. For each of SAMPLES samples and each word, hashes of word
and sample give uniform numbers, from which come r and c (gamma distributed with shape 2) and b (uniform):

    t = floor(ln S / r + b),   ln a = ln c - r * (t + 1 - b)

The word with the least a is the sample, together with its t. Two documents have the same sample with a probability
equal to their generalised Jaccard similarity (sum of least weights over sum of greatest), so the part of equal samples
estimates it. Of a sample, 24 bits made of the word's hash and t are kept; the least a and those bits travel in one long, so
that a minimum over longs finds them.

Scale: words are counted inside the row, by sorting hashes and measuring runs; no word is shuffled. Texts are shuffled
once, by ranges of the key, since each needs the document that follows it: ranges come from approximate quantiles and hold
about RANGE_ROWS rows, or a 16384th of all rows where that is more. A key that fills ranges of its own, null or not, is dealt
further by a hash of the text. The first text of each range, found by its key, goes to the range before it; only numbers of
ranges are put in order in one task. Rows that agree in key and text are the only ones that stay together.

Defined results: a null or empty text, or one of white space, has a fingerprint of zeros; two of those are alike (1);
rows that repeat a key follow one another, by a hash of their texts; a null key comes last; a single document follows
itself; an empty table gives an empty one; columns other than key and text are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kontor.llm import scratch

SAMPLES = 32
HEX = 6
RANGE_ROWS = 1000
#: Ranges are found by two searches through at most so many bounds.
BOUNDS = 128
#: Hashes of texts that order rows of one key.
TIES = 1 << 30


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often a lambda inside refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def weighted_words(text: Column) -> Column:
    """array<struct<word: long, weight: int>>: hashes of the words of a text and how often each occurs."""

    def counted(hashes: Column) -> Column:
        n = F.size(hashes)
        ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (F.get(hashes, i - 1) != F.get(hashes, i)))
        runs = _let(
            ends,
            lambda e: F.transform(
                e, lambda end, j: F.struct(F.get(hashes, end - 1).alias("word"), (end - F.when(j == 0, F.lit(0)).otherwise(F.get(e, j - 1))).alias("weight"))
            ),
        )
        return F.when(n > 0, runs)

    words = F.filter(F.split(text, r"[\x09-\x0D\x20]+"), lambda w: w != "")
    return _let(F.sort_array(F.transform(words, lambda w: F.xxhash64(w))), counted)


def sample(word: Column, log_weight: Column, k: int) -> Column:
    """What sample k makes of a word: 39 bits of ln a, then 24 bits that name the word and its t."""
    one, two = F.xxhash64(word, F.lit(2 * k)), F.xxhash64(word, F.lit(2 * k + 1))

    def uniform(bits: Column, width: int) -> Column:
        return (bits.bitwiseAND(F.lit((1 << width) - 1)) + F.lit(0.5)) * F.lit(2.0**-width)

    r = -F.log(uniform(one, 32) * uniform(F.shiftrightunsigned(one, 32), 32))
    log_c = F.log(-F.log(uniform(two, 24) * uniform(F.shiftrightunsigned(two, 24), 24)))
    b = uniform(F.shiftrightunsigned(two, 48), 16)
    t = F.floor(log_weight / r + b)
    log_a = log_c - r * (t + F.lit(1.0) - b)
    order = ((log_a + F.lit(128.0)) * F.lit(2.0**31)).cast("long")
    name = F.shiftrightunsigned(word, k % 40).bitwiseXOR(t).bitwiseAND(F.lit((1 << 24) - 1))
    return F.shiftleft(order, 24).bitwiseOR(name)


def fingerprints(rows: DataFrame, keys: list[str], text: str, samples: int = SAMPLES) -> DataFrame:
    """(keys, fingerprint) for each distinct value of `keys`, which must tell the rows apart."""
    words = rows.select(*keys, F.explode_outer(weighted_words(F.coalesce(F.col(text), F.lit("")))).alias("_w"))
    words = words.select(*keys, F.col("_w.word").alias("_word"), F.log(F.col("_w.weight")).alias("_log"))
    least = words.groupBy(*keys).agg(*(F.min(sample(F.col("_word"), F.col("_log"), k)).alias(f"_{k}") for k in range(samples)))
    parts = [F.coalesce(F.lower(F.lpad(F.hex(F.col(f"_{k}").bitwiseAND(F.lit((1 << 24) - 1))), HEX, "0")), F.lit("0" * HEX)) for k in range(samples)]
    return least.select(*keys, F.concat(*parts).alias("fingerprint"))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The part of equal samples: an estimate of the generalised Jaccard similarity."""
    equal = [F.when(F.substring(a, HEX * k + 1, HEX) == F.substring(b, HEX * k + 1, HEX), 1).otherwise(0) for k in range(samples)]
    return sum(equal[1:], equal[0]) / F.lit(float(samples))


def ranges(docs: DataFrame, key: str) -> tuple[Column, dict]:
    """An expression for the range (int) that a key lies in: ascending, about RANGE_ROWS rows each, -1 for null; and for keys that fill ranges, how many."""
    rows, known = docs.agg(F.count("*"), F.count(key)).first()
    side = min(BOUNDS, max(1, math.ceil(math.sqrt(rows / RANGE_ROWS))))
    n = side * side
    full = {None: max(1, math.ceil((rows - known) * n / max(rows, 1)))}
    if n == 1 or not known:
        return F.when(F.col(key).isNull(), -1).otherwise(0), full
    found = docs.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 20 * n)).first()[0]
    full |= {k: m for k, m in Counter(found).items() if m > 1}
    coarse = [found[i * side - 1] for i in range(1, side)]
    fine = [found[i * side : i * side + side - 1] for i in range(side)]
    at = F.size(F.filter(F.lit(coarse) if coarse else F.array(), lambda x: x <= F.col(key)))
    inner = F.size(F.filter(F.element_at(F.array(*map(F.lit, fine)), at + 1), lambda x: x <= F.col(key)))
    return F.when(F.col(key).isNull(), -1).otherwise(at * side + inner), full


def _part(key: str, full: dict) -> Column:
    """The part of its range that a row (key, tie) lies in: 0, but for keys that fill ranges. They are the least of their ranges and come last there."""
    found = F.lit(0)
    if heavy := {k: m for k, m in full.items() if k is not None}:
        parts = F.element_at(F.create_map(*(F.lit(x) for pair in heavy.items() for x in pair)), F.col(key))
        found = F.when(parts.isNotNull(), 1 + F.floor(F.col("tie") * parts / TIES)).otherwise(0)
    return F.when(F.col(key).isNull(), F.floor(F.col("tie") * full[None] / TIES)).otherwise(found).cast("int")


def _beyond(heads: DataFrame, value: str, to: str) -> DataFrame:
    """(range, part, to): of heads (range, part, value), one row for each part, the value of the part after it, and of the first after the last."""
    down = Window.orderBy(F.col("range").desc(), "part")
    own = F.struct("range", "part")
    order = heads.select("range", "part", F.coalesce(F.lead(own).over(down), F.first(own).over(down)).alias("_after"))
    values = heads.select(F.struct("range", "part").alias("_after"), F.col(value).alias(to))
    return order.join(values, "_after").drop("_after")


def with_following_text(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(range, part, place, key, text, following): texts (null: empty) by descending key, each with the next one's."""
    bucket, full = ranges(docs.select(key), key)
    rows = docs.select(bucket.alias("range"), F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.pmod(F.xxhash64("text"), F.lit(TIES))).withColumn("part", _part("key", full))
    # The first row of each part, found by key and tie alone; then the texts of those few.
    tops = rows.groupBy("range", "part").agg(F.max(F.struct("key", -F.col("tie"))).alias("_top")).select(F.col("range").alias("_range"), F.col("part").alias("_part"), "_top")
    is_top = (F.col("range") == F.col("_range")) & (F.col("part") == F.col("_part")) & F.col("key").eqNullSafe(F.col("_top.key")) & (F.col("tie") == -F.col("_top.col2"))
    heads = scratch.written(rows.join(F.broadcast(tops), is_top).groupBy("range", "part").agg(F.min("text").alias("first")), "first_texts")
    inside = Window.partitionBy("range", "part").orderBy(F.col("key").desc(), "tie", "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartition(parts, "range", "part").withColumn("place", F.row_number().over(inside)).withColumn("_next", F.lead("text").over(inside))
    return placed.join(_beyond(heads, "first", "_beyond"), ["range", "part"]).select("range", "part", "place", "key", "text", F.coalesce("_next", "_beyond").alias("following"))


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last third comes from the start of the next document."""
    rows = with_following_text(docs, key, text).withColumn("n_chars", F.length("text").cast("long"))
    swapped = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.left("text", (F.col("n_chars") - swapped).cast("int")), F.left("following", swapped))
    rows = rows.select("range", "part", "place", "key", "n_chars", "text", edited.alias("edited")).withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    keys = ["range", "part", "place", "key", "n_chars", "edited_sha256", "which"]
    both = rows.select("range", "part", "place", "key", "n_chars", "edited_sha256", F.posexplode(F.array("text", "edited")).alias("which", "_text"))
    made = fingerprints(both, keys, "_text", samples)
    # One row for each document; the grouping by range holds for it, too.
    pair = made.groupBy(*keys[:-1]).agg(
        F.max(F.when(F.col("which") == 0, F.col("fingerprint"))).alias("fingerprint"), F.max(F.when(F.col("which") == 1, F.col("fingerprint"))).alias("edited_fingerprint")
    )
    pair = scratch.written(pair, "fingerprints")
    inside = Window.partitionBy("range", "part").orderBy("place")
    beyond = _beyond(pair.where("place = 1").select("range", "part", "fingerprint"), "fingerprint", "_beyond")
    pair = pair.withColumn("_next", F.lead("fingerprint").over(inside)).join(beyond, ["range", "part"]).withColumn("next_fingerprint", F.coalesce("_next", "_beyond"))
    return pair.select(
        F.col("key").alias(key),
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint"), samples).alias("near_next"),
    )


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
