"""Near copies by the similarity of their shingle sets: operator 6's index on a wide SimHash, exact verification.

Two texts are near copies if the sets of their word shingles have a Jaccard similarity of at least `LEAST`. At 0.8 a bit of
two SimHashes differs with a probability of 0.15, so that 64 bits differ in ten or so, which may touch every byte: operator
6's own fingerprint does not find them. Here a SimHash has BYTES = 96 bytes. The index lists sets by positional bytes: a
list holds those that agree in a byte at a position and in half of the byte after it (12 bits). A pair at 0.8 shares each
of the 96 lists with a probability of 0.139, and none with about (1 - 0.139)^96 = 6e-7 (3e-4 for sets of four and five
shingles, where ties differ more often). Pairs of a list whose sizes allow the similarity and whose first HEAD bits differ
in at most HEAD_BITS are candidates. Their shared positional bytes are tallied: a pair at 0.8 shares 26 of 96 on average,
others 0.4; those under MIN_SHARED go. The rest are verified bit by bit (WIDE), and then on the 64-bit hashes of their shingles.

Scale: equal sets are merged before anything is paired. Lists are sorted by size, so that a set meets only those of a size
that allows the similarity, all lists of a batch at once. A list gives all its candidates, unless it is dense: of more than
SHORT sets, with more candidates than sets among its neighbours by size. Of a dense one, a spanning forest of them, which
starts at the set in the middle, is found; of a set's edges in all forests, the HUBS closest by their first bits are verified first, and then
only what lies in different components and can share enough:
shingles that no other set of a dense list holds do not count, the others are counted by parts of their hashes, and the
lesser counts bound what is shared. A large group of near copies costs a few rows per member and list. Only texts of
candidates are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kontor.llm import scratch
from kontor.llm.components import components
from kontor.llm.simhash import SEED, SHORT

WORDS, LEAST = 5, (4, 5)
#: Bytes of a SimHash, in words of 64 bits; each position has lists.
BYTES = 96
#: Positional bytes that two sets share at least, and bits in which they differ at most.
MIN_SHARED, WIDE = 4, 192
#: Bits that go with a set into its lists, and in how many of them a candidate differs at most: a pair at 0.8 in more with a
#: probability of 2e-10 (2e-6 for sets of four and five shingles).
HEAD, HEAD_BITS = 256, 78
HEADS = [f"head{i}" for i in range(HEAD // 64)]
#: Edges of a set to the sets that it hangs at in dense lists, which are verified first; what they leave is compared afterwards.
HUBS = 4
#: Rows of lists that are compared at once.
AT_ONCE = 1 << 16
#: A set's shingles are counted in 2^SLOT_BITS parts to bound what two sets share.
SLOT_BITS = 5
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BYTES // 8, 1), np.uint64) | np.array([0, 1], np.uint64)[:, None, None]
#: The least bit of every byte of a word.
_ONES = np.uint64(0x0101010101010101)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Hashes of the text's distinct word shingles, ascending; of a shorter text, of all its words; empty without words."""
    import xxhash

    # As in operator 6: bytes, so that ASCII only is split and lower-cased. Words are hashed one by one, shingles from their hashes.
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    size = min(words, len(found))
    n = len(found) - size + 1
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = (out ^ hashes[i : i + n]) * _STEP
        out ^= out >> np.uint64(32)
    return np.unique(out * _STEP ^ (out >> np.uint64(29)))


def set_id(found: np.ndarray) -> int:
    """What names a set: a signed long."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes(), SEED)).view(np.int64))


def simhashes(found: list[np.ndarray]) -> np.ndarray:
    """The SimHash of each set, BYTES bytes in a row; zeros for the empty one."""
    sizes = np.array([len(x) for x in found], np.int64)
    out = np.zeros((len(found), BYTES), np.uint8)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    sizes = sizes[some]
    flat = np.concatenate([found[i] for i in some.tolist()])
    # Blocks of up to 255 shingles, whose counts of a bit fit in a byte: eight counters are added in one word.
    blocks = -(-sizes // 255)
    first = np.cumsum(blocks) - blocks
    starts = np.repeat(np.cumsum(sizes) - sizes, blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(first, blocks))
    counts = np.empty((len(starts), 8, BYTES), np.uint8)
    at, cuts = 0, np.append(starts, len(flat))
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + 2048, "right")) - 1)
        hashes = (flat[cuts[at] : cuts[to]] ^ _MIX[0]) * _MIX[1]
        hashes ^= hashes >> np.uint64(32)
        for i in range(8):
            lanes = np.add.reduceat((hashes >> np.uint64(i)) & _ONES, starts[at:to] - cuts[at], axis=1)
            counts[at:to, i] = np.ascontiguousarray(lanes.T).view(np.uint8)
        at = to
    total = np.add.reduceat(counts, first, axis=0, dtype=np.int32)
    out[some] = np.packbits(2 * total > sizes[:, None, None], axis=1, bitorder="little")[:, 0]
    return out


def list_keys(prints: np.ndarray) -> np.ndarray:
    """The lists of each SimHash, one for each position: the position, its byte and half of the next one's."""
    return (np.arange(BYTES) << 12 | prints.astype(np.int64) << 4 | np.roll(prints, -1, axis=1) & 15).astype(np.int32)


def _prints(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BYTES)


def _heads(prints: np.ndarray) -> np.ndarray:
    """The words that go with a set into its lists."""
    return np.ascontiguousarray(np.ascontiguousarray(prints[:, : HEAD // 8]).view(np.int64).T)


def _headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, n, print) to (id, n, heads)."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *map(pa.array, _heads(_prints(batch.column(2))))], names=["id", "n", *HEADS])


def hashed(docs: DataFrame, *others: str, text: str = "text") -> DataFrame:
    """(others, id, n, print) for every row: the set of its text by name, its size and its SimHash."""
    scratch.small_batches(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [shingles(x) for x in part.column(len(others)).to_pylist()]
                columns = [pa.array(map(set_id, found), pa.int64()), pa.array(map(len, found), pa.int32()), pa.array([x.tobytes() for x in simhashes(found)], pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], names=[*others, "id", "n", "print"])

    made = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("print", T.BinaryType())])
    schema = T.StructType([*docs.select(*others).schema, *made])
    return docs.select(*others, text).mapInArrow(rows, schema)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, n, print) to (key, id, n, heads), one for each list; the empty set is in none, it equals only itself."""
    for batch in batches:
        batch = batch.filter(pa.array(batch.column(1).to_numpy() > 0))
        if batch.num_rows:
            prints = _prints(batch.column(2))
            whole = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), *_heads(prints)]
            for rows in np.array_split(np.arange(batch.num_rows), -(-batch.num_rows // 256)):
                yield pa.RecordBatch.from_arrays([pa.array(list_keys(prints[rows]).reshape(-1)), *(pa.array(np.repeat(c[rows], BYTES)) for c in whole)], names=["key", "id", "n", *HEADS])


def _close(heads: list[np.ndarray], i: np.ndarray | int, j: np.ndarray | slice) -> np.ndarray:
    """Which pairs of places can be near copies by the first bits of their SimHashes."""
    return sum(np.bitwise_count((h[i] ^ h[j]).view(np.uint64)) for h in heads) <= HEAD_BITS


def _may(heads: list[np.ndarray], n: np.ndarray, i: np.ndarray | int, j: np.ndarray | slice) -> np.ndarray:
    """Which pairs of places can be near copies by size and SimHash."""
    part, whole = LEAST
    return _close(heads, i, j) & (whole * np.minimum(n[i], n[j]) >= part * np.maximum(n[i], n[j]))


def _from_middle(fp: np.ndarray) -> np.ndarray:
    """Places by their distance from the majority of all bits, so that lists of one group begin with the same sets."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(fp), 1 << 16):
        counts += np.unpackbits(fp[at : at + (1 << 16)].view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return np.argsort(np.bitwise_count((fp ^ np.packbits(2 * counts > len(fp)).view(np.int64)[0]).view(np.uint64)), kind="stable")


def _forest(heads: list[np.ndarray], n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the candidates of a dense list: places, and what hangs at them."""
    rest, queue = _from_middle(heads[0]), []
    while len(rest):
        if queue:
            node = queue.pop()
        else:
            node, rest = rest[0], rest[1:]
        near = _may(heads, n, node, rest)
        queue.extend(rest[near])
        yield np.full(near.sum(), node), rest[near]
        rest = rest[~near]


def _between(heads: list[np.ndarray], n: np.ndarray, label: np.ndarray, slots: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates of a dense list between different components whose counts by slot allow the similarity."""
    part, whole = LEAST
    names, at, count = np.unique(label, return_inverse=True, return_counts=True)
    large = at == count.argmax()
    done = np.zeros(len(n), bool)
    for i in np.flatnonzero(~large).tolist():
        done[i] = True
        other = np.flatnonzero(~done & (label != label[i]))
        other = other[_may(heads, n, i, other)]
        shared = sum(np.minimum(slot[i], slot[other]) for slot in slots)
        other = other[(part + whole) * shared >= part * (n[i] + n[other])]
        yield np.full(len(other), i), other


def _lists(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the lists, which lie side by side."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return starts, np.diff(np.append(starts, len(keys)))


def _made(ids: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], forests: list[tuple[int, np.ndarray, np.ndarray]], heads: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    """Pairs of places as rows (a, b, null, 0); of a dense list every member as (id, where it hangs, key, differing bits), a root hangs nowhere (null)."""
    i, j = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in pairs)]) for k in (0, 1))
    members, above = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in forests)]) for k in (1, 2))
    key = np.repeat(np.array([x[0] for x in forests], np.int32), np.array([len(x[1]) for x in forests], np.int64))
    a, b = np.concatenate((np.minimum(ids[i], ids[j]), ids[members])), np.concatenate((np.maximum(ids[i], ids[j]), ids[above]))
    bits = np.concatenate((np.zeros(len(i)), sum(np.bitwise_count((h[members] ^ h[above]).view(np.uint64)) for h in heads))).astype(np.int32)
    pair, root = np.arange(len(a)) < len(i), np.concatenate((np.zeros(len(i), bool), members == above))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=root), pa.array(np.concatenate((np.zeros(len(i), np.int32), key)), mask=pair), pa.array(bits)], names=["a", "b", "key", "bits"])


def _first(keys: np.ndarray, ids: np.ndarray, n: np.ndarray, *heads: np.ndarray) -> pa.RecordBatch:
    """Candidates of lists that are sorted by size: all of them, or a forest of a dense list and its members that are in it."""
    part, whole = LEAST
    starts, sizes = _lists(keys)
    which = np.repeat(np.arange(len(starts)), sizes)
    n = n.astype(np.int64)
    at, dense, pairs, count = np.arange(len(keys)), np.zeros(0, np.int64), [], np.zeros(len(starts), np.int64)
    d = 0
    while len(at):
        d += 1
        if d == SHORT:
            dense = np.flatnonzero((sizes > SHORT) & (count > sizes))
            at = at[~np.isin(which[at], dense)]
            pairs = [(i[keep], j[keep]) for i, j in pairs for keep in [~np.isin(which[i], dense)]]
        at = at[at + d < len(keys)]
        # Whoever has no partner at this distance has none beyond.
        at = at[(keys[at + d] == keys[at]) & (whole * n[at] >= part * n[at + d])]
        near = at[_close(heads, at, at + d)]
        if len(near):
            pairs.append((near, near + d))
            count += np.bincount(which[near], minlength=len(count))
    forests = []
    for k in dense.tolist():
        s, e = starts[k], starts[k] + sizes[k]
        above, below = (s + np.concatenate(x) for x in zip(*_forest([h[s:e] for h in heads], n[s:e])))
        roots = np.setdiff1d(above, below)
        forests.append((int(keys[s]), np.concatenate((roots, below)), np.concatenate((roots, above))))
    return _made(ids, pairs, forests, heads)


def _second(keys: np.ndarray, ids: np.ndarray, n: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """Candidates that the forests of dense lists left. columns: the heads, label and slots."""
    pairs, words = [], HEAD // 64
    for s, size in zip(*map(np.ndarray.tolist, _lists(keys))):
        own = [c[s : s + size] for c in (n, *columns)]
        pairs += [(i + s, j + s) for i, j in _between(own[1 : 1 + words], own[0], own[1 + words], own[2 + words :]) if len(i)]
    return _made(ids, pairs, [], columns[:words])


def _pairs(of):
    """A function of batches (key, ...), lists side by side, that gives whole lists to `of`, many at once."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            rows += batch.num_rows
            if rows >= AT_ONCE and waiting[0][0][0] != waiting[-1][0][-1]:
                columns = [np.concatenate(c) for c in zip(*waiting)]
                cut = int(np.searchsorted(columns[0], columns[0][-1]))
                yield of(*(c[:cut] for c in columns))
                waiting = [[c[cut:] for c in columns]]
                rows -= cut
        if waiting:
            yield of(*(np.concatenate(c) for c in zip(*waiting)))

    return pairs


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs (a, b, x, y) with their SimHashes, those that share enough positional bytes, and differ in few enough bits."""
    for batch in batches:
        differ = _prints(batch.column(2)) ^ _prints(batch.column(3))
        passed = (differ == 0).sum(axis=1) >= MIN_SHARED
        passed[passed] = np.bitwise_count(differ[passed]).sum(axis=1) <= WIDE
        yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(passed))


def mark(text: Column) -> Column:
    """A name for a text; empty for null."""
    return F.coalesce(F.md5(text.cast("binary")), F.lit(""))


def _who(key: Column, own: Column) -> Column:
    """What a row is looked up by: copies of one text under many keys are dealt to many tasks."""
    return F.struct(key.alias("key"), own.alias("mark"))


def _sets(docs: DataFrame, asked: DataFrame, key: str, text: str) -> DataFrame:
    """(id, shingles array<long>) of the rows that are asked for by `who`, made again from one copy of each."""

    def bare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                found = [shingles(x) for x in batch.column(0).slice(at, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(map(set_id, found), pa.int64()), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))], names=["id", "shingles"])

    rows = docs.select(_who(F.col(key), mark(F.col(text))).alias("who"), F.col(text).alias("text")).join(asked, "who", "left_semi")
    return rows.groupBy("who").agg(F.min("text").alias("text")).select("text").mapInArrow(bare, "id long, shingles array<long>")


def _sets_of(docs: DataFrame, sets: DataFrame, ids: DataFrame, key: str, text: str) -> DataFrame:
    """(id, shingles) of the sets that are asked for by id, as a table. sets: (id, best)."""
    asked = scratch.written(sets.join(ids, "id", "left_semi").select(_who(F.col("best.key"), F.col("best.mark")).alias("who")), "candidate_rows")
    return scratch.written(_sets(docs, asked, key, text), "candidate_sets")


def _checked(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that are near copies. found: (id, shingles)."""
    both = pairs.join(found.toDF("a", "x"), "a").join(found.toDF("b", "y"), "b").select("a", "b", "x", "y")
    # Pair by pair within Spark: sets of long texts would fill a batch for Python.
    part, whole = LEAST
    shared, total = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
    return both.where(whole * shared >= part * (total - shared)).select("a", "b")


def _slots() -> list[str]:
    return [f"slot{i}" for i in range(1 << SLOT_BITS)]


def _counted(found: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, slots): of each set asked for, the shingles that another of them holds, counted by slot. found: (id, shingles)."""
    each = found.join(ids, "id", "left_semi").select("id", F.explode("shingles").alias("shingle"))
    alone = each.groupBy("shingle").agg(F.count("*").alias("holders"), F.min("id").alias("id")).where("holders = 1")
    signed = each.withColumn("one", F.lit(1)).union(alone.select("id", "shingle", F.lit(-1)))
    slot = F.shiftrightunsigned("shingle", 64 - SLOT_BITS)
    return signed.groupBy("id").agg(*(F.sum(F.when(slot == i, F.col("one")).otherwise(0)).alias(c) for i, c in enumerate(_slots())))


def labels(docs: DataFrame, sets: DataFrame, key: str, text: str) -> DataFrame:
    """(node, label): components of `sets` that have a near copy. sets: a table (id, n, print, best), best being the row of each."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "key int, id long, n int, " + ", ".join(f"{h} long" for h in HEADS)

    def dealt(rows: DataFrame, of, name: str) -> DataFrame:
        return scratch.written(rows.repartition(parts, "key").sortWithinPartitions("key", "n", "id").mapInArrow(_pairs(of), "a long, b long, key int, bits int"), name)

    def tallied(pairs: DataFrame, name: str) -> DataFrame:
        prints = sets.select("id", "print")
        both = pairs.join(prints.toDF("a", "x"), "a").join(prints.toDF("b", "y"), "b").select("a", "b", "x", "y")
        return scratch.written(both.mapInArrow(_tallied, "a long, b long"), name)

    listed = sets.select("id", "n", "print").mapInArrow(_listed, schema)
    found = dealt(listed, _first, "candidates")
    # A set hangs at one other in each of its dense lists, of which there are BYTES at most.
    closest = found.where("key IS NOT NULL AND b IS NOT NULL").groupBy("a").agg(F.slice(F.array_sort(F.collect_set(F.struct("bits", "b"))), 1, HUBS).alias("at"))
    closest = closest.select("a", F.explode("at.b").alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = tallied(found.where("key IS NULL").select("a", "b").union(closest).distinct(), "candidates_tallied")
    dense = scratch.written(found.where("key IS NOT NULL").select("key", F.col("a").alias("id")), "near_dense")
    # Whoever is in a second pair is in a dense list, so these are all the sets that are needed.
    shingled = _sets_of(docs, sets, pairs.select(F.explode(F.array("a", "b")).alias("id")).union(dense.select("id")).distinct(), key, text)
    links = scratch.written(_checked(shingled, pairs), "near_links")
    nodes = components(links, "a", "b")
    if dense.isEmpty():
        return nodes
    counted = scratch.written(_counted(shingled, dense.select("id").distinct()), "near_slots")
    own = sets.select("id", "n", "print").mapInArrow(_headed, schema.replace("key int, ", "")).join(counted, "id").join(nodes.withColumnRenamed("node", "id"), "id", "left")
    members = dense.join(scratch.written(own.withColumn("label", F.coalesce("label", "id")), "near_members"), "id").select("key", "id", "n", *HEADS, "label", *_slots())
    between = dealt(members, _second, "candidates_between").select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti")
    more = tallied(between, "candidates_left")
    if more.isEmpty():
        return nodes
    return components(links.union(scratch.written(_checked(shingled, more), "near_links_left")), "a", "b")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without near copies: of every component, the row with the least key (null last) and then the least digest of its text stays."""
    own = mark(F.col(text))
    found = scratch.written(hashed(docs.select(F.col(key).alias("key"), own.alias("mark"), text), "key", "mark", text=text), "near_hashed")
    best = F.min(F.struct(F.col("key").isNull().alias("last"), "key", "mark")).alias("best")
    sets = scratch.written(found.groupBy("id").agg(F.min("n").alias("n"), F.min("print").alias("print"), best), "near_sets")
    nodes = labels(docs, sets, key, text)
    rows = sets.select("id", "best").join(nodes.withColumnRenamed("node", "id"), "id", "left").groupBy(F.coalesce("label", "id")).agg(F.min("best").alias("best"))
    kept = scratch.written(rows.select(F.col("best.key").alias("_key"), F.col("best.mark").alias("_mark")), "near_kept")
    named = docs.withColumn("_own", own).join(kept, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_own") == F.col("_mark")), "left_semi")
    return named.dropDuplicates([key, "_own"]).drop("_own")
