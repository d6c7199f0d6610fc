"""Exact top-k search by columnar branch-and-bound (operator 2).

Candidates lie in blocks in vertical layout: one array for each dimension. For a query, scores build up dimension block
by dimension block, the query's heaviest dimensions first. What the dimensions not yet read can add is bounded by the
masses that remain, of the candidate and of the query (Cauchy-Schwarz). Candidates that cannot reach the query's k-th
score any more go, and the arrays are compacted to the survivors before the next block of dimensions is read.

Thresholds are carried: candidates are dealt to blocks by norm, the block of the greatest norms is searched first, and
its k-th score bounds every later block from its first dimension on. Within a block pieces come by descending norm, and
the search of a block ends where norms alone cannot reach the threshold; queries are not even sent to such blocks.

Scale: blocks of candidates and of queries have a fixed size (a class of equal norms is dealt further by a hash of ids,
so that a vector that repeats fills many blocks); each pair of blocks meets once, in a task whose memory the two sizes
bound. A stated query set is searched against all rows; of each pair of blocks only the k best of each query leave the
task, and these are reduced again by query. One row for each of up to CLASSES classes of norms reaches the driver.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part, nor do rows without
id; vectors are compared with those of their own length; rows that repeat an id are all candidates, except for queries
of that id; of queries that repeat an id, the one whose vector comes first in order is asked; ties go to smaller ids; an
empty table gives an empty result. Scores are exact; scores outside the longs end at their limits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kontor.llm import scratch

K, EVERY, SCALE = 20, 20, 64
#: Rows of a block of candidates, and of a block of queries; rows of a piece of a block; dimensions read at once.
CANDIDATES, QUERIES, PIECE, DIMENSIONS = 8192, 2048, 4096, 8
#: Classes of norms that blocks are dealt by.
CLASSES = 256

_HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, v array<double>): floor(scale * x) of each component x of the vectors that take part."""
    x = F.col(vector)
    limit = F.lit(1.7976931348623157e308 / scale)  # beyond it the product is not finite
    usable = F.col(key).isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= limit))
    floors = F.transform(x, lambda c: _floor(c.cast("double") * F.lit(float(scale))))
    return vectors.where(usable).select(F.col(key).cast("long").alias("id"), floors.alias("v"))


def _floor(x: Column) -> Column:
    """Floor as a double, also beyond the longs, where doubles are whole."""
    return F.when(F.abs(x) < F.lit(9.0e15), F.floor(x).cast("double")).otherwise(x)


class Block:
    """Candidates of one length, in vertical layout, in pieces of descending norm."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        mass = np.einsum("ij,ij->i", rows, rows)
        order = np.lexsort((ids, -mass))
        self.ids, self.mass, self.columns = ids[order], mass[order], np.ascontiguousarray(rows[order].T)
        self.exact = float(np.abs(rows).max(initial=0)) ** 2 * rows.shape[1] < 2.0**52
        #: Components read so far, by all searches.
        self.read = 0

    def _whole(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """By Python's integers, where doubles are not exact."""
        rows = [(max(-(1 << 63), min((1 << 63) - 1, sum(int(a) * int(b) for a, b in zip(query, self.columns[:, i])))), i) for i in np.flatnonzero(self.ids != own).tolist()]
        rows = sorted(rows, key=lambda r: (-r[0], self.ids[r[1]]))[:k]
        return self.ids[[i for _, i in rows]], np.array([s for s, _ in rows], np.int64)

    def best(self, own: int, query: np.ndarray, k: int, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best candidates but the query's own, best first; those under `floor` may be left out."""
        if not self.exact or float(np.abs(query).max(initial=0)) ** 2 * len(query) >= 2.0**52:
            return self._whole(own, query, k)
        order = np.argsort(-np.abs(query), kind="stable")
        query = query[order]
        # Square roots are rounded; the slack keeps them above what they bound.
        left = np.sqrt(np.append(np.cumsum((query**2)[::-1])[::-1], 0.0)) * (1 + 1e-9)
        found, scores = np.zeros(0, np.int64), np.zeros(0)
        for at in range(0, len(self.ids), PIECE):
            if np.sqrt(self.mass[at]) * left[0] < floor:
                break
            ids, mass, rest, rows = self.ids[at : at + PIECE], self.mass[at : at + PIECE], self.columns[:, at : at + PIECE], order
            among = k + int((ids == own).sum())
            score = np.zeros(len(ids))
            for d in range(0, len(query), DIMENSIONS):
                part = rest[rows[:DIMENSIONS]]
                rows = rows[DIMENSIONS:]
                self.read += part.size
                score = score + query[d : d + DIMENSIONS] @ part
                if not len(rows) or not len(ids):
                    continue
                mass = mass - np.einsum("ij,ij->j", part, part)
                reach = np.sqrt(np.maximum(mass, 0.0)) * left[d + DIMENSIONS]
                least = floor
                if least == -np.inf and len(score) > among:  # reached by k candidates, whatever comes
                    least = np.partition(score - reach, len(score) - among)[len(score) - among]
                keep = np.flatnonzero(score + reach >= least)
                if len(keep) < 0.6 * len(ids):
                    # One array of the survivors' remaining dimensions, in the order in which they are read.
                    ids, mass, score, rest = ids[keep], mass[keep], score[keep], rest[np.ix_(rows, keep)]
                    rows = np.arange(len(rows))
            other = (ids != own) & (score >= floor)
            found, scores = np.concatenate((found, ids[other])), np.concatenate((scores, score[other]))
            first = np.lexsort((found, -scores))[:k]
            found, scores = found[first], scores[first]
            if len(scores) == k:
                floor = max(floor, scores[-1])
        return found, scores.astype(np.int64)


def _matrices(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, rows and thresholds, by length of vector."""
    ids, vectors = table.column("id").to_numpy(), table.column("v").combine_chunks()
    if not len(ids):
        return {}
    ends = vectors.offsets.to_numpy()
    values, sizes = vectors.values.to_numpy(), np.diff(ends)
    floors = table.column("floor").to_numpy() if "floor" in table.column_names else np.zeros(len(ids))
    found = {}
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        found[d] = ids[at], values[ends[at][:, None] + np.arange(d)], floors[at]
    return found


def _meet(k: int):
    def meet(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        rows: list[list[np.ndarray]] = [[], [], []]
        asked = _matrices(queries)
        for d, (ids, vectors, _) in _matrices(candidates).items():
            if d not in asked:
                continue
            block = Block(ids, vectors)
            for own, query, floor in zip(*asked[d]):
                found, scores = block.best(own, query, k, floor)
                for out, x in zip(rows, (np.full(len(found), own), found, scores)):
                    out.append(x)
        return pa.table([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in rows], schema=_HITS)

    return meet


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def _norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def _blocks(rows: DataFrame) -> tuple[DataFrame, list[tuple[int, float]]]:
    """Candidates (id, v, norm) with `a`, their block; blocks and the greatest norm in them, by descending norm."""
    n = max(1, min(CLASSES, -(-rows.count() // CANDIDATES)))
    cuts = (rows.agg(F.percentile_approx("norm", [i / n for i in range(1, n)], 20 * n)).first()[0] if n > 1 else None) or []
    dealt = rows.withColumn("class", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c > F.col("norm"))) if cuts else F.lit(0))
    sizes, found, first = dealt.groupBy("class").agg(F.count("*").alias("n"), F.max("norm").alias("norm")).orderBy("class").collect(), [], {}
    for r in sizes:
        first[r["class"]] = len(found), -(-r["n"] // CANDIDATES)
        found += [(len(found) + i, r["norm"]) for i in range(first[r["class"]][1])]
    if not found:
        return dealt.withColumn("a", F.lit(0).cast("long")), []
    start, parts = (F.create_map(*(F.lit(x) for c, pair in first.items() for x in (c, pair[at]))) for at in (0, 1))
    here = F.col("class")
    return dealt.withColumn("a", (F.element_at(start, here) + F.pmod(F.xxhash64("id"), F.element_at(parts, here).cast("long"))).cast("long")), found


def search(candidates: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k candidates of other ids with the highest inner product. Both: (id, v)."""
    rows, blocks = _blocks(candidates.select("id", "v", _norm(F.col("v")).alias("norm")))
    asked = queries.groupBy(F.col("id").alias("id")).agg(F.min("v").alias("v")).withColumn("norm", _norm(F.col("v")))
    n = max(1, -(-asked.count() // QUERIES))
    asked = asked.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(n)))
    rows = rows.select("id", "v", "a", F.explode(_numbers(n)).alias("b"))

    def hits(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.groupBy("a", "b").cogroup(right.select("id", "v", "floor", "a", "b").groupBy("a", "b")).applyInArrow(_meet(k), "query_id long, vec_id long, score long")

    none = F.lit(float("-inf"))
    found = scratch.written(hits(rows.where("a = 0"), asked.select("*", F.lit(0).cast("long").alias("a"), none.alias("floor"))), "top_first")
    if len(blocks) > 1:
        seen = found.groupBy("query_id").agg(F.min("score").cast("double").alias("least"), F.count("*").alias("n")).where(F.col("n") >= k)
        known = asked.join(seen.withColumnRenamed("query_id", "id"), "id", "left").withColumn("floor", F.coalesce("least", none))
        others = F.array(*(F.struct(F.lit(a).cast("long").alias("a"), F.lit(norm).alias("most")) for a, norm in blocks[1:]))
        reached = F.filter(others, lambda x: ~(x["most"] * F.col("norm") * F.lit(1 + 1e-9) < F.col("floor")))
        found = found.union(hits(rows.where("a > 0"), known.select("id", "v", "b", "floor", F.explode(reached["a"]).alias("a"))))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return search(rows, rows.where(F.col("id") % EVERY == 0))


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
