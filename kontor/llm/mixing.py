"""Mixing sources to target weights (operator 7): a time-varying curriculum.

Every source has a weight schedule over the run, piecewise linear between shared breakpoints. Its integral is the
source's cumulative demand of tokens. The documents of a source lie one after the other in an order by hash of key and
text, lap after lap; inverting the cumulative demand at the middle of a document gives its training position, and a
range sort by position gives the training order.

Scale: sizes are counted where the text is read and only (key, source, size, hash) goes on. Running sums within a source
go by buckets of the hash, so a source with a third of all documents is spread like any other, and so is a key that
repeats, null or not; one row for each source and bucket is sorted in one task. No source reaches the driver. Only rows
that agree in key, source and text stay side by side; arranged() numbers them, on disk if need be, and never collects them.

Defined results: a null text has size 0 and is in no mix, like one without words; a null source is a source of its own,
the last; a null key is a key like any other; repeated rows are taken one by one; all sizes 0 give targets 0; an empty
table gives an empty one; columns other than key, source and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kontor.llm import scratch
from kontor.llm.prefix import sums_before

WEIGHTS = (3, 1, 2)
SHARE, LIMIT = 1.5, 2
#: Breakpoints of time, and for each weight of WEIGHTS the relative intensity at them: the heaviest sources come early.
TIMES = (0.0, 0.5, 1.0)
INTENSITY = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
#: Documents of a bucket, on average at most.
BUCKET_ROWS = 2000


def mark(key: Column, text: Column) -> Column:
    """What a document's place in its source is decided by: the MD5 of key and text."""
    own = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    return F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(" "), own).cast("binary"))


def source_name(source: Column) -> Column:
    """A source that is never null: keys of joins and windows then agree and share their shuffle."""
    return F.when(source.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), source))


def sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, source, size, mark): words of the whole text."""
    words = F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    return docs.select(F.col(key).alias("key"), F.col(source).alias("source"), words.cast("long").alias("size"), mark(F.col(key), F.col(text)).alias("mark"))


def targets(sized: DataFrame) -> DataFrame:
    """(source, at, weight, source_size, target) for each source; at is its place by code point, null last.

    Targets share SHARE times the whole size by weight and stop at LIMIT times the source's size. Reshared until none
    is above, that is one level per weight: full sources come first by limit per weight, and the level is what is left
    for the rest per weight, where the next source would not fill.
    """
    ordered = Window.orderBy(F.col("source").isNull(), "source")
    found = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("at", F.row_number().over(ordered))
    found = found.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("at") - 1) % len(WEIGHTS) + 1).cast("int")))
    by = Window.orderBy(LIMIT * F.col("source_size") / F.col("weight"), "at")
    rows = (Window.unboundedPreceding, -1), (Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    found = (
        found.withColumn("limit", LIMIT * F.col("source_size"))
        .withColumn("full", F.coalesce(F.sum("limit").over(by.rowsBetween(*rows[0])), F.lit(0)))
        .withColumn("open", F.sum("weight").over(by.rowsBetween(*rows[1])))
        .withColumn("level", (SHARE * F.sum("source_size").over(everything).cast("double") - F.col("full")) / F.col("open"))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("limit") / F.col("weight"), F.struct("full", "at", "level"))).over(everything)["level"])
    )
    return found.select("source", "at", "weight", "source_size", F.least(F.col("limit").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def _position(share: Column, weight: Column) -> Column:
    """The time by which the given share of a source's whole demand has come up: the inverse of the integral."""

    def invert(intensity: tuple[float, ...]) -> Column:
        areas = [(b - a) * (y + z) / 2 for a, b, y, z in zip(TIMES, TIMES[1:], intensity, intensity[1:])]
        whole, before, out = sum(areas), 0.0, F.lit(TIMES[-1])
        pieces = []
        for a, b, y, z, area in zip(TIMES, TIMES[1:], intensity, intensity[1:], areas):
            slope, rest = (z - y) / (b - a), share * whole - before
            # y * t + slope / 2 * t^2 = rest, in the form that holds for slope 0 too
            pieces.append((before + area, a + 2 * rest / (y + F.sqrt(F.greatest(F.lit(y * y) + 2 * slope * rest, F.lit(0.0))))))
            before += area
        for end, piece in reversed(pieces):
            out = F.when(share * whole <= end, piece).otherwise(out)
        return F.least(out, F.lit(TIMES[-1]))

    out = invert(INTENSITY[0])
    for w, intensity in list(zip(WEIGHTS, INTENSITY))[1:]:
        out = F.when(weight == w, invert(intensity)).otherwise(out)
    return out


def _placed(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(name, key, mark, size, offset, weight, source_size, target) for each document: `offset` words of its source come before it."""
    sized = scratch.written(sizes(docs, key, text, source), "sizes")
    digits = max(1, math.ceil(math.log(max(1, sized.count() / BUCKET_ROWS), 16)))
    rows = sized.select(source_name(F.col("source")).alias("name"), "key", "size", "mark").withColumn("bucket", F.substring("mark", 1, digits))
    rows = sums_before(rows, ["name"], "bucket", [F.col("mark"), F.col("key").isNull(), F.col("key")], "size", "offset")
    goals = scratch.written(targets(sized).select(source_name(F.col("source")).alias("name"), "weight", "source_size", "target"), "targets")
    return rows.join(goals, "name").drop("bucket")


def _positions(offset: Column, plan: Callable[[str], Column]) -> Column:
    """Training positions of the copies taken of a document, ascending; `plan` gives its size, source_size, weight and target."""
    middles = [2 * (offset + lap * plan("source_size")) + plan("size") for lap in range(LIMIT)]  # doubled: whole numbers
    copies = [F.when((plan("size") > 0) & (m <= 2 * plan("target")), _position(m / (2 * plan("target")), plan("weight"))) for m in middles]
    return F.array_compact(F.array(*copies))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row for each document: key, size, source_size, target, taken, positions (ascending; one for each copy taken).

    A copy is taken if its middle lies within the source's target, so that the words taken miss the target by half a
    document at most.
    """
    rows = _placed(docs, key, text, source).withColumn("positions", _positions(F.col("offset"), F.col))
    return rows.select(F.col("key").alias(key), "size", "source_size", "target", (F.size("positions") * F.col("size")).alias("taken"), "positions")


def arranged(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of `docs` that the mix takes, as often as it takes them, range-sorted by training position (ties by mark)."""
    same = ["_name", "_mark"]
    plan = _placed(docs, key, text, source).where("size > 0").withColumnsRenamed({"name": "_name", "mark": "_mark"})
    # Rows of one key, source and text follow each other: the first one's offset gives those of all.
    plan = plan.groupBy(*same).agg(F.min("offset").alias("offset"), F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("size", "weight", "source_size", "target")))
    plan = plan.where(2 * F.col("offset") + F.col("size") <= 2 * F.col("target")).select(*same, F.struct("offset", "n", "size", "weight", "source_size", "target").alias("_plan"))
    plan = scratch.written(plan, "mixture")
    rows = docs.withColumn("_name", source_name(F.col(source))).withColumn("_mark", mark(F.col(key), F.col(text))).join(plan, same)
    before = F.lit(0).cast("long")
    if not plan.where("_plan.n > 1").isEmpty():
        number = F.row_number().over(Window.partitionBy(*same).orderBy(*same)) - 1
        rows = rows.where("_plan.n = 1").withColumn("_before", before).union(rows.where("_plan.n > 1").withColumn("_before", number * F.col("_plan.size")))
        before = F.col("_before")
    rows = rows.withColumn("_position", F.explode(_positions(F.col("_plan.offset") + before, lambda c: F.col(f"_plan.{c}"))))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, "_position", "_mark").sortWithinPartitions("_position", "_mark").select(*docs.columns)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With `position` and `position_again`: when, from 0 to 1, the first and the second copy are trained on; -1: it is not taken. Rows are range-sorted by position, those not taken last."""
    rows = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    never = F.lit(-1.0)
    rows = rows.withColumns({"position": F.coalesce(F.get("positions", F.lit(0)), never), "position_again": F.coalesce(F.get("positions", F.lit(1)), never)}).drop("positions")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("position") < 0, F.col("position"), F.col("doc_id")]
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)


def _position_sql(share: str, weight: str) -> str:
    """SQL for the time by which a share of the whole demand has come up."""
    choices = []
    for w, rates in zip(WEIGHTS, INTENSITY):
        whole = sum((b - a) * (y + z) / 2 for a, b, y, z in zip(TIMES, TIMES[1:], rates, rates[1:]))
        before, pieces = 0.0, []
        for a, b, y, z in zip(TIMES, TIMES[1:], rates, rates[1:]):
            slope, rest = (z - y) / (b - a), f"({share} * {whole}::DOUBLE - {before}::DOUBLE)"
            end = before + (b - a) * (y + z) / 2
            pieces.append(f"WHEN {share} * {whole}::DOUBLE <= {end}::DOUBLE THEN {a}::DOUBLE + 2 * {rest} / ({y}::DOUBLE + sqrt(greatest({y * y}::DOUBLE + {2 * slope}::DOUBLE * {rest}, 0)))")
            before = end
        choices.append(f"WHEN {weight} = {w} THEN least(CASE {' '.join(pieces)} ELSE {TIMES[-1]}::DOUBLE END, {TIMES[-1]}::DOUBLE)")
    return f"CASE {' '.join(choices)} END"


OP7_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || md5(coalesce(text, ''))) AS mark,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS place
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2 * source_size AS most FROM sources
), levels AS (
  SELECT *, (1.5 * CAST(sum(source_size) OVER () AS DOUBLE)
             - CAST(coalesce(sum(most) OVER (ORDER BY most / CAST(weight AS DOUBLE), place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
            / CAST(sum(weight) OVER (ORDER BY most / CAST(weight AS DOUBLE), place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level,
         row_number() OVER (ORDER BY most / CAST(weight AS DOUBLE), place) AS turn
  FROM weighed
), chosen AS (
  SELECT level FROM levels WHERE level <= CAST(most AS DOUBLE) / weight ORDER BY turn LIMIT 1
), goals AS (
  SELECT source, source_size, weight, least(CAST(most AS DOUBLE), (SELECT level FROM chosen) * weight) AS target FROM levels
), placed AS (
  SELECT s.*, g.source_size, g.target, g.weight,
         CAST(coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY mark, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
), middles AS (
  SELECT *, 2 * before + size AS once, 2 * (before + source_size) + size AS again FROM placed
), positions AS (
  SELECT *, CASE WHEN size > 0 AND once <= 2 * target THEN {_position_sql("(once / (2 * target))", "weight")} ELSE -1 END AS position,
         CASE WHEN size > 0 AND again <= 2 * target THEN {_position_sql("(again / (2 * target))", "weight")} ELSE -1 END AS position_again
  FROM middles
)
SELECT doc_id, size, source_size, target, position, position_again,
       size * (CAST(position >= 0 AS BIGINT) + CAST(position_again >= 0 AS BIGINT)) AS taken
FROM positions
"""
