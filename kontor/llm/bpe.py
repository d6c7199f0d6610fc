"""Byte-level BPE encoding and decoding by a global shuffle of distinct words (operator 9).

Encoding:
1. each task splits whole texts into pre-tokens and packs them by blocks of documents: the block's own vocabulary, and
   for every document the positions of its words in it. The blocks are written once, bucketed by block;
2. the vocabularies are exploded into buckets by word and shuffled; each distinct word of the corpus is encoded once, in
   the one place where its bucket is;
3. the ids go back to their blocks by a join on the block (the blocks are read in place, without a second shuffle of
   positions), and each document is put together by position.

Pre-aggregation: a word travels once per block, however often it occurs, so a very frequent word is as many rows as
there are blocks, and texts never travel. Memory of a task is bounded by BLOCK_TOKENS and BLOCK_WORDS plus one document.

Decoding joins each id with the token-byte table. Its size is that of the vocabulary, so each worker holds it and joins ids
by their place in it, in order, without a shuffle.

Defined results: a null or empty text has no ids; repeated rows and equal or null keys give one result row each; columns
other than the key and the text are not read; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kontor.llm import pretokens, scratch

#: A block is closed when it holds so many pre-tokens or so many distinct words.
BLOCK_TOKENS, BLOCK_WORDS = 1_200_000, 200_000
#: Words (as often as there are blocks that hold them) in each bucket of the shuffle by word, on average.
BUCKET_WORDS = 200_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks, from a file of the tiktoken format."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@cache
def word_encoder(path: str):
    """An encoder that takes each text it is given as one pre-token."""
    import tiktoken

    return tiktoken.Encoding("word", pat_str=r"(?s:.+)", mergeable_ranks=ranks(path), special_tokens={})


def _pack(values: np.ndarray) -> bytes:
    """Non-negative integers as compressed planes of their bytes, lowest first."""
    import zstandard

    wide = np.ascontiguousarray(values, dtype="<u4")
    planes = wide.view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=3).compress(len(wide).to_bytes(8, "little") + planes.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(raw[:8], "little")
    return np.frombuffer(raw, np.uint8, offset=8).reshape(4, n).T.copy().view("<u4").reshape(-1)


def _zip(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(data)


def _unzip(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


class _Vocabulary(dict):
    """Words by order of first sight."""

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        return place


def _blocks(key: pa.DataType):
    """Rows (key, text) to rows of blocks."""
    schema = pa.schema([("block", pa.int64()), ("keys", pa.list_(key)), ("lengths", pa.binary()), ("places", pa.binary()), ("words", pa.binary()), ("n_words", pa.int64())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        words, keys, lengths, places, tokens = _Vocabulary(), [], [], [], 0

        def closed() -> pa.RecordBatch:
            # The most frequent words get the smallest places, which compresses best.
            flat = np.concatenate([*places, np.zeros(0, np.uint32)]).astype(np.uint32)
            order = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
            rank = np.empty(len(words), np.uint32)
            rank[order] = np.arange(len(words), dtype=np.uint32)
            spelt = list(words)
            text = [spelt[i].encode("utf-8", "surrogatepass") for i in order.tolist()]
            blob = _pack(np.fromiter(map(len, text), np.uint32, len(text)))
            blob = len(blob).to_bytes(8, "little") + blob + _zip(b"".join(text))
            row = [[block], [keys], [_pack(np.array(lengths, np.uint32))], [_pack(rank[flat])], [blob], [len(text)]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, schema.types)], schema=schema)

        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = pretokens.split_bytelevel(text or "")
                keys.append(k)
                lengths.append(len(found))
                places.append(np.fromiter(map(words.__getitem__, found), np.uint32, len(found)))
                tokens += len(found)
                if tokens >= BLOCK_TOKENS or len(words) >= BLOCK_WORDS:
                    yield closed()
                    block += 1
                    words, keys, lengths, places, tokens = _Vocabulary(), [], [], [], 0
        if keys:
            yield closed()

    return pack


def _spelt(blob: bytes) -> list[bytes]:
    n = int.from_bytes(blob[:8], "little")
    ends = np.cumsum(_unpack(blob[8 : 8 + n]), dtype=np.int64)
    text = _unzip(blob[8 + n :])
    return [text[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


_DEALT = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("places", pa.binary()), ("words", pa.binary())])


def _deal(buckets: int):
    """Explodes each block's vocabulary into one row for each bucket of words that it touches."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = _spelt(blob)
                bucket = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)).astype(np.int64) % buckets
                order = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
                rows = []
                for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)]):
                    own = order[a:b]
                    text = [words[i] for i in own.tolist()]
                    sizes = _pack(np.fromiter(map(len, text), np.uint32, len(text)))
                    rows.append((int(bucket[own[0]]), block, _pack(own), len(sizes).to_bytes(8, "little") + sizes + _zip(b"".join(text))))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _DEALT.types)], schema=_DEALT)

    return deal


def _encode_buckets(vocabulary: str):
    """Rows sorted by bucket: every distinct word of a bucket is encoded once."""
    schema = pa.schema([("at_block", pa.int64()), ("at", pa.binary()), ("counts", pa.binary()), ("ids", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, now, known = word_encoder(vocabulary), None, {}
        for batch in batches:
            rows = []
            for bucket, block, places, blob in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if bucket != now:
                    now, known = bucket, {}
                words = _spelt(blob)
                for w in words:
                    if w not in known:
                        known[w] = encoder.encode_ordinary(w.decode("utf-8", "surrogatepass"))
                ids = [known[w] for w in words]
                counts = np.fromiter(map(len, ids), np.uint32, len(ids))
                rows.append((block, places, _pack(counts), _pack(np.fromiter((i for x in ids for i in x), np.uint32, int(counts.sum())))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return encode


def _assemble(key_name: str, key: pa.DataType, packed: bool):
    """A block and the ids of its words: one row for each document, ids in the order of the text, as a list or packed."""
    to = pa.binary() if packed else pa.list_(pa.int32())

    def assemble(blocks: pa.Table, found: pa.Table) -> pa.Table:
        out_keys, out_lists = [], []
        for row in blocks.to_pylist():
            n = row["n_words"]
            sizes, starts = np.zeros(n, np.int32), np.zeros(n, np.int32)
            parts, base = [], 0
            for x in found.to_pylist():
                at, counts, ids = _unpack(x["at"]), _unpack(x["counts"]).astype(np.int64), _unpack(x["ids"])
                sizes[at] = counts
                starts[at] = base + np.cumsum(counts) - counts
                base += len(ids)
                parts.append(ids)
            flat = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
            places, lengths = _unpack(row["places"]), _unpack(row["lengths"])
            size = sizes[places]
            ends = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
            # The place of each id in flat: where its word starts, and then one after the other.
            kind = np.int32 if ends[-1] < 1 << 31 else np.int64
            at = np.repeat((starts[places] - ends[:-1]).astype(kind), size)
            at += np.arange(len(at), dtype=kind)
            ids = flat[at].view(np.int32)
            ends = ends[np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))]
            out_keys.append(pa.array(row["keys"], key))
            if packed:
                cuts = ends.tolist()
                out_lists.append(pa.array([_pack(ids[a:b]) for a, b in zip(cuts, cuts[1:])], to))
            else:
                out_lists.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)))
        names = [key_name, "token_ids"]
        if not out_keys:
            return pa.table([pa.array([], key), pa.array([], to)], names=names)
        return pa.table([pa.chunked_array(out_keys), pa.chunked_array(out_lists)], names=names)

    return assemble


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, packed: bool = False) -> DataFrame:
    """(key, token_ids array<int>) for every row of `docs`; with `packed`, token_ids are binary, smaller in a shuffle."""
    from pyspark.sql.pandas.types import to_arrow_type

    scratch.small_batches(docs.sparkSession)
    spark, vocabulary = docs.sparkSession, vocabulary or vocabulary_path()
    kind = docs.schema[key].dataType
    arrow = to_arrow_type(kind)
    stored = T.StructType(
        [
            T.StructField("block", T.LongType()),
            T.StructField("keys", T.ArrayType(kind)),
            T.StructField("lengths", T.BinaryType()),
            T.StructField("places", T.BinaryType()),
            T.StructField("words", T.BinaryType()),
            T.StructField("n_words", T.LongType()),
        ]
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = scratch.bucketed(docs.select(key, text).mapInArrow(_blocks(arrow), stored), "bpe_blocks", parts, "block")
    words = blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    buckets = max(parts, -(-words // BUCKET_WORDS))
    dealt = blocks.select("block", "words").mapInArrow(_deal(buckets), "bucket long, block long, places binary, words binary")
    found = (
        dealt.repartition(parts, "bucket")
        .sortWithinPartitions("bucket", "block")
        .mapInArrow(_encode_buckets(vocabulary), "at_block long, at binary, counts binary, ids binary")
    )
    out = T.StructType([T.StructField(key, kind), T.StructField("token_ids", T.BinaryType() if packed else T.ArrayType(T.IntegerType()))])
    left = blocks.select("block", "keys", "lengths", "places", "n_words").groupBy("block")
    return left.cogroup(found.groupBy("at_block")).applyInArrow(_assemble(key, arrow, packed), out)


def _bytes_of(vocabulary: str) -> list[bytes]:
    table: list[bytes] = [b""] * (1 + max(ranks(vocabulary).values()))
    for token, rank in ranks(vocabulary).items():
        table[rank] = token
    return table


def _lists(column: pa.ListArray) -> Iterator[list[int] | None]:
    """The lists of a column, one at a time."""
    values, ends = column.values.to_numpy(), column.offsets.to_numpy()
    for i, valid in enumerate(column.is_valid().to_pylist()):
        yield values[ends[i] : ends[i + 1]].tolist() if valid else None


def decode(encoded: DataFrame, ids: str = "token_ids", to: str = "decoded", vocabulary: str | None = None) -> DataFrame:
    """`encoded` with the bytes that its ids stand for: the join with the token-byte table, kept in order. Null stays null."""
    vocabulary = vocabulary or vocabulary_path()
    at = encoded.columns.index(ids)
    schema = T.StructType([f for f in encoded.schema if f.name != to] + [T.StructField(to, T.BinaryType())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = _bytes_of(vocabulary).__getitem__
        for batch in batches:
            made = [None if x is None else b"".join(map(token, x)) for x in _lists(batch.column(at))]
            kept = [(c, f) for c, f in zip(batch.columns, batch.schema) if f.name != to]
            yield pa.RecordBatch.from_arrays([*(c for c, _ in kept), pa.array(made, pa.binary())], names=[*(f.name for _, f in kept), to])

    return encoded.mapInArrow(join, schema)


def placed(docs: DataFrame) -> DataFrame:
    """`docs` with _place (long): ascending in the order of the rows in the part files that `docs` is read from.

    Where `docs` is not read from files, the place is that of the row in the partitions of `docs`.
    """
    try:
        rows = docs.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_index"))
    except AnalysisException:
        return docs.withColumn("_place", F.monotonically_increasing_id())
    part, piece = (F.coalesce(F.regexp_extract("_file", pattern, 1).try_cast("long"), F.lit(0).cast("long")) for pattern in (r"^part-(\d+)", r"-c(\d+)\."))
    return rows.withColumn("_place", F.shiftleft(part, 42) + F.shiftleft(piece, 32) + F.col("_index")).drop("_file", "_index")


def encoded_in_order(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(key, position, token_ids, exact) for every row of `docs`, in their order: position ascends with it, exact says that the decoded ids are the text (null: empty)."""
    vocabulary = vocabulary or vocabulary_path()
    rows = placed(docs).select(F.struct(F.col(key).alias("key"), "_place", F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash")).alias("row"), F.col(text).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = encode(rows, "row", "text", vocabulary, packed=True).select(F.col("row.key").alias(key), F.col("row._place").alias("position"), F.col("row.hash").alias("hash"), "token_ids")
    found = found.repartitionByRange(parts, "position").sortWithinPartitions("position")

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        token = _bytes_of(vocabulary).__getitem__
        for batch in batches:
            for part in (batch.slice(at, 500) for at in range(0, batch.num_rows, 500)):
                ids = [_unpack(x) for x in part.column(3).to_pylist()]
                # Spark's xxhash64 of a string has seed 42.
                exact = [xxhash.xxh64_intdigest(b"".join(map(token, x.tolist())), 42) == h % (1 << 64) for x, h in zip(ids, part.column(2).to_pylist())]
                lists = pa.array([x.view(np.int32) for x in ids], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists, pa.array(exact, pa.bool_())], names=[key, "position", "token_ids", "exact"])

    out = [found.schema[key], T.StructField("position", T.LongType()), T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("exact", T.BooleanType())]
    return found.mapInArrow(opened, T.StructType(out))


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """What the registered query returns of (key, token_ids, decoded)."""
    spelt = F.concat_ws(" ", F.col("token_ids").cast("array<string>"))
    return encoded.select(
        key,
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(spelt, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(decode(encode(docs)))
