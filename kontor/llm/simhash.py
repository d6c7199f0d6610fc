"""Near-duplicates by SimHash (operator 6): byte-position inverted index with count filtering.

A fingerprint of 64 bits is 8 positional bytes. Two fingerprints that differ in at most 4 bits share at least 4 of
them. The index lists fingerprints by positional bytes; the pairs of a list get their shared bytes tallied, those
under the guaranteed minimum go, the rest are verified bit by bit.

A list for one byte would hold a 256th of all fingerprints, so that pairs would grow with the square of the corpus.
The index key is therefore a combination of three positions and their bytes (24 bits). The combinations are the 20 of
Turan's construction, of which every four positions contain one: no link is missed.

Scale: copies are merged by fingerprint before anything is paired (pre-aggregated in the map); of each list, only the
edges of a spanning forest of its links leave the task, found by breadth-first search with vectorised comparisons, so a
large group of near copies costs a few rows per member and never its square. Lists are streamed in sorted order; one of
more than LONG fingerprints is dealt out again by a fourth positional byte (two linked fingerprints share four), to tasks
of their own. Links become components through tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kontor.llm import scratch
from kontor.llm.components import components

WORDS, SEED, BYTES = 4, 42, 8
#: Lists of up to so many fingerprints are compared by offsets, all lists at once; longer ones by search.
SHORT = 16
#: Lists of more fingerprints are split by a fourth byte.
LONG = 4096


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The 64-bit SimHash of the text's word shingles, repeats included; 0 without words."""
    import xxhash

    # Splitting and lower-casing bytes touches ASCII only: white space \x20 and \x09-\x0D, letters A-Z.
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    flat = b" ".join(found)
    size = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    n = max(1, len(found) - words + 1)
    last = ends[words - 1 :] if len(found) >= words else ends[-1:]
    digest, seed = xxhash.xxh64_digest, SEED
    hashes = b"".join([digest(flat[a:b], seed) for a, b in zip(starts[:n].tolist(), last.tolist())])
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 19):  # long texts in pieces
        bits = np.unpackbits(np.frombuffer(hashes[at : at + (1 << 19)], np.uint8)).reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(key, fp) for every row; fp is the fingerprint as a signed long."""
    scratch.small_batches(docs.sparkSession)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x, words) for x in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=[key, "fp"])

    return docs.select(key, text).mapInArrow(hashed, T.StructType([docs.schema[key], T.StructField("fp", T.LongType())]))


def position_triples() -> list[tuple[int, int, int]]:
    """Triples of positions such that any four positions contain one: inside a group, or two of it and one of the next."""
    group = [p * 3 // BYTES for p in range(BYTES)]
    return [t for t in combinations(range(BYTES), 3) if sorted(group[p] for p in t) in ([0, 0, 0], [1, 1, 1], [2, 2, 2], [0, 0, 1], [1, 1, 2], [0, 2, 2])]


def _keys(fp: Column) -> Column:
    def byte(p: int) -> Column:
        return F.shiftrightunsigned(fp, 8 * p).bitwiseAND(F.lit(255).cast("long"))

    return F.array(*(F.lit(i << 24).cast("long") + byte(a) * 65536 + byte(b) * 256 + byte(c) for i, (a, b, c) in enumerate(position_triples())))


def _near(x: np.ndarray, bits: int) -> np.ndarray:
    """Of differences of pairs: those with the guaranteed number of shared bytes, verified."""
    shared = (x.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
    passed = shared >= BYTES - bits
    passed[passed] = np.bitwise_count(x[passed]) <= bits
    return passed


def _list_links(keys: np.ndarray, fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the fingerprints of each list (equal keys, side by side): at least a spanning forest of each."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(starts, len(keys)))
    long = np.repeat(sizes > SHORT, sizes)
    left, right = [], []
    for d in range(1, min(SHORT, int(sizes.max(initial=1)))):
        at = np.flatnonzero((keys[d:] == keys[:-d]) & ~long[:-d])
        if not len(at):
            break
        at = at[_near(fps[at] ^ fps[at + d], bits)]
        left.append(fps[at])
        right.append(fps[at + d])
    for i in np.flatnonzero(sizes > SHORT).tolist():
        rest = fps[starts[i] : starts[i] + sizes[i]]
        queue: list[np.uint64] = []
        while len(rest):
            if queue:
                node = queue.pop()
            else:
                node, rest = rest[0], rest[1:]
            near = _near(rest ^ node, bits)
            if near.any():
                found = rest[near]
                queue.extend(found)
                left.append(np.full(len(found), node))
                right.append(found)
                rest = rest[~near]
    none = [np.zeros(0, np.uint64)]
    return np.concatenate(left or none), np.concatenate(right or none)


def _fourth(key: int, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints of a list again, once for each position that its key leaves open, under longer keys."""
    open_positions = [p for p in range(BYTES) if p not in position_triples()[key >> 24]]
    found = [((np.int64(key) << 11) | (p << 8)) | ((fps >> np.uint64(8 * p)) & np.uint64(255)).astype(np.int64) for p in open_positions]
    return np.concatenate(found), np.tile(fps, len(open_positions))


def _links(bits: int, split: bool):
    """Sorted rows (key, fp) to links (a, b, null), and with `split` rows (key, fp, true) of the parts of long lists."""

    def made(a: np.ndarray, b: np.ndarray, part: bool | None) -> pa.RecordBatch:
        columns = [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array([part], pa.bool_()).take(pa.array(np.zeros(len(a), np.int64)))]
        return pa.RecordBatch.from_arrays(columns, names=["a", "b", "part"])

    def whole(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        if split and len(keys) > LONG:
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            sizes = np.diff(np.append(starts, len(keys)))
            for i in np.flatnonzero(sizes > LONG).tolist():
                yield made(*_fourth(int(keys[starts[i]]), fps[starts[i] : starts[i] + sizes[i]]), True)
            short = np.repeat(sizes <= LONG, sizes)
            keys, fps = keys[short], fps[short]
        if len(keys):
            yield made(*_list_links(keys, fps, bits), None)

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_keys, open_fps = [], []  # the list at the end of what was read
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            fps = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if open_keys and open_keys[-1][-1] == keys[-1]:
                open_keys.append(keys)
                open_fps.append(fps)
                continue
            cut = int(np.searchsorted(keys, keys[-1]))
            yield from whole(np.concatenate([*open_keys, keys[:cut]]), np.concatenate([*open_fps, fps[:cut]]))
            open_keys, open_fps = [keys[cut:]], [fps[cut:]]
        if open_keys:
            yield from whole(np.concatenate(open_keys), np.concatenate(open_fps))

    return links


def link_fingerprints(distinct: DataFrame, bits: int = 4) -> DataFrame:
    """Edges (a, b) that connect all of `distinct` (fp: unique) within `bits` bits of each other; at most 4 of 8 bytes may differ."""
    if not 0 <= bits <= BYTES - 4:
        raise ValueError("the index guarantees links of up to 4 bits")
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def linked(lists: DataFrame, split: bool) -> DataFrame:
        return lists.repartition(parts, "key").sortWithinPartitions("key", "fp").mapInArrow(_links(bits, split), "a long, b long, part boolean")

    found = scratch.written(linked(distinct.select(F.explode(_keys(F.col("fp"))).alias("key"), "fp"), True), "simhash_links")
    parts_of_long = found.where("part").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    links = found.where("part IS NULL").select("a", "b")
    return links if parts_of_long.isEmpty() else links.union(linked(parts_of_long, False).select("a", "b"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = 4) -> DataFrame:
    """(key, fp, component) for every row of `docs`: component is the least key that is reachable by links.

    Null and empty texts have fingerprint 0 and link like any other; a row without key takes part and is ignored by the
    least key; repeated rows are in one component; other columns are not read.
    """
    hashed = scratch.written(fingerprints(docs, key, text), "simhash")
    merged = scratch.written(hashed.groupBy("fp").agg(F.min(key).alias("least")), "simhash_merged")
    labels = components(link_fingerprints(merged, bits).where("a <> b"), "a", "b")
    labelled = scratch.written(merged.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label")), "simhash_labels")
    least = labelled.groupBy("label").agg(F.min("least").alias("component"))
    classes = scratch.written(labelled.join(least, "label").select("fp", "component"), "simhash_classes")
    return hashed.join(classes, "fp").select(key, "fp", "component")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = 4) -> DataFrame:
    """`docs` without near-duplicates: of every component, the row with the least key (null last) and then the least digest of its text stays.

    Rows that share a key and differ in their texts are rows of their own.
    """
    mark = F.coalesce(F.md5(F.col(text).cast("binary")), F.lit(""))
    who = F.struct(F.col(key).isNull().alias("last"), F.col(key).alias("key"), mark.alias("mark"))
    found = near_duplicates(docs.select(who.alias("who"), text), "who", text, bits)
    kept = found.where(F.col("who").eqNullSafe(F.col("component"))).select(F.col("who.key").alias("_key"), F.col("who.mark").alias("_mark")).distinct()
    named = docs.withColumn("_own", mark).join(kept, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_own") == F.col("_mark")), "left_semi")
    return named.dropDuplicates([key, "_own"]).drop("_own")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
