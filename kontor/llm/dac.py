"""Token-id files with directly addressable codes (operator 3).

Ids are split into chunks of 8 bits, level by level. Level 0 has the lowest chunk of every id and a bitmap that says
which ids go on; level 1 has the next chunk of those only, and so on. The place of an id's next chunk is the number of
ones before it in the bitmap (its rank), which a directory of counts every 512 bits answers at once. Any id, and the ids
of any document, are read without decoding what comes before.

Writing: documents are range-partitioned and sorted by key, encoded as they stream by, and written as files of about
FILE_TOKENS ids, under names that follow the order of keys. A file appears under its name only when it is complete; its
name is that of one attempt of a task, and the manifest, one row for each file of the attempts that counted, decides which
files there are. Ids are encoded once: the texts are what is shuffled. The running sum of the manifest gives the place of
each file in the whole.

Encoding uses the model of the tokenizers library word by word, each worker remembering up to CACHE_WORDS words.
Normalising and splitting is done here, for characters that this does just as the library, which is asked the first time
that a worker meets a character. Texts with any other character, texts that are not in normal form, and texts that spell a
special token are encoded by the library as a whole.

Defined results: a null or empty text has just the end id; a null key comes first; rows that repeat a key stay, ordered by
a hash of their texts, by which a hot key is spread over ranges, too;
columns other than key and text are not read; an empty table gives no file and an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kontor.llm import pretokens, scratch

END_ID = 1
FILE_TOKENS = 4_000_000
CACHE_WORDS = 1_000_000
BLOCK = 512
MAGIC = b"DAC1"


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself, or else the next free one from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)}


class WordEncoder(dict):
    """From a word, lower-case and normalised, to its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        #: Characters that were compared with the library: those that it treats alike, and the others.
        self.alike, self.other = {chr(c) for c in range(128)}, set()

    def __missing__(self, word: str) -> bytes:
        self[word] = found = np.array([t.id for t in self.model.tokenize(self._spelt(word))], "<u4").tobytes()
        return found

    def _spelt(self, word: str) -> str:
        return word.encode("utf-8").decode("latin-1").translate(self.letters)

    def _words(self, text: str) -> list[str]:
        """The words of a text in normal form. The library lowers letter by letter, without the final form of sigma."""
        return pretokens.split_words(text.replace("Σ", "σ").lower())

    def _compare(self, characters: set[str]) -> None:
        """Sorts new characters by whether splitting a context of each is what the library does."""
        import unicodedata

        for c in characters:
            context = f"{c} a{c}b {c}{c} 1{c}2 !{c}? 's{c} '{c}s"
            same = unicodedata.category(c) != "Cn" and unicodedata.is_normalized("NFC", context)
            if same:
                normal = self.whole.normalizer.normalize_str(context)
                same = [self._spelt(w) for w in self._words(context)] == [w for w, _ in self.whole.pre_tokenizer.pre_tokenize_str(normal)]
            (self.alike if same else self.other).add(c)

    def _own(self, text: str) -> bool:
        """Whether the words of a text are split here."""
        import unicodedata

        if not text.isascii():
            found = set(text)
            if not found <= self.alike:
                self._compare(found - self.alike - self.other)
                if not found.isdisjoint(self.other):
                    return False
            if not unicodedata.is_normalized("NFC", text):
                return False
        return not any(s in text for s in self.special)

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, as the library gives them without adding special tokens."""
        if not self._own(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        found = b"".join(map(self.__getitem__, self._words(text)))
        if len(self) > CACHE_WORDS:
            self.clear()
        return found


@cache
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pack(keys: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A file: header, keys, starts of documents, then chunks, bitmap and rank directory of each level."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.int64) if len(more) else np.zeros(0, np.int64)
        levels.append(((rest & 255).astype(np.uint8), bits, (np.cumsum(ones) - ones).astype("<u8")))
        if not more.any():
            break
        rest = rest[more] >> np.uint32(8)
    known = np.array([k is not None for k in keys], np.uint8)
    parts = [MAGIC, np.array([len(keys), len(ids), len(levels), *(len(x[0]) for x in levels)], "<u8").tobytes()]
    parts += [known.tobytes(), np.array([k or 0 for k in keys], "<i8").tobytes(), np.concatenate(([0], np.cumsum(lengths))).astype("<u8").tobytes()]
    for level in levels:
        parts += [x.tobytes() for x in level]
    return b"".join(parts)


class DacFile:
    """Reads a file's bytes in place."""

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        self._data, self._at = data, len(MAGIC)
        docs, self.n_ids, levels = self._take("<u8", 3).tolist()
        sizes = self._take("<u8", levels).tolist()
        known, keys = self._take("u1", docs).tolist(), self._take("<i8", docs).tolist()
        self.keys = [k if there else None for k, there in zip(keys, known)]
        self.starts = self._take("<u8", docs + 1).astype(np.int64)
        self.levels = [(self._take("u1", n), self._take("u1", -(-n // 8)), self._take("<u8", -(-n // BLOCK))) for n in sizes]

    def _take(self, kind: str, n: int) -> np.ndarray:
        found = np.frombuffer(self._data, kind, n, self._at)
        self._at += found.nbytes
        return found

    def rank(self, level: int, i: int) -> int:
        """Ones before position i of a level's bitmap."""
        chunks, bits, counts = self.levels[level]
        block = min(i // BLOCK, len(counts) - 1) if len(counts) else 0
        first = block * BLOCK
        own = np.unpackbits(bits[first // 8 : -(-i // 8)], bitorder="little")[: i - first]
        return (int(counts[block]) if len(counts) else 0) + int(own.sum())

    def get(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value, level = 0, 0
        while True:
            chunks, bits, _ = self.levels[level]
            value |= int(chunks[i]) << (8 * level)
            if not bits[i // 8] >> (i % 8) & 1:
                return value
            i, level = self.rank(level, i), level + 1

    def ids(self, a: int = 0, b: int | None = None) -> np.ndarray:
        """The ids of positions a to b, read where they lie."""
        b = self.n_ids if b is None else b
        out = np.zeros(b - a, np.uint32)
        at = slice(None)
        for level, (chunks, bits, _) in enumerate(self.levels):
            part = chunks[a:b].astype(np.uint32) << np.uint32(8 * level)
            out[at] |= part
            first = a // 8
            more = np.unpackbits(bits[first : -(-b // 8)], bitorder="little")[a - 8 * first : b - 8 * first].astype(bool)
            if not more.any():
                break
            at = np.flatnonzero(more) if level == 0 else at[more]
            a, b = self.rank(level, a), self.rank(level, b)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


def _store(folder: str, name: str, data: bytes) -> None:
    """Writes a complete file under its name, whatever store the folder is in."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(folder)
    store.create_dir(at, recursive=True)
    half = f"{at}/.{name}"
    with store.open_output_stream(half) as out:
        out.write(data)
    store.move(half, f"{at}/{name}")


def write_files(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes the token files and returns the manifest (file, part, seq, docs, tokens), itself a written table."""
    scratch.small_batches(docs.sparkSession)
    vocabulary = vocabulary or vocabulary_path()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = word_encoder(vocabulary), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        keys, pieces, tokens = [], [], 0

        def closed() -> pa.RecordBatch:
            name = f"{part:08d}-{seq:06d}-{TaskContext.get().taskAttemptId()}.dac"
            lengths = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
            _store(folder, name, pack(keys, lengths, np.frombuffer(b"".join(pieces), "<u4")))
            return pa.RecordBatch.from_pydict({"file": [name], "part": [part], "seq": [seq], "docs": [len(keys)], "tokens": [int(lengths.sum())]})

        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pieces.append(encoder.encode(x or "") + end)
                keys.append(k)
                tokens += len(pieces[-1]) // 4
                if tokens >= FILE_TOKENS:
                    yield closed()
                    keys, pieces, tokens, seq = [], [], 0, seq + 1
        if keys:
            yield closed()

    rows = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    rows = rows.repartitionByRange(parts, "key", "hash").sortWithinPartitions("key", "hash").select("key", "text")
    return scratch.written(rows.mapInArrow(write, "file string, part long, seq long, docs long, tokens long"), "dac_manifest")


def read_files(spark: SparkSession, folder: str, manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of each document in the files: key, start in the whole, n_tokens, ids_crc32, file, and place in its file."""
    out = "file string, place long, key long, local long, n_tokens long, ids_crc32 long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = DacFile(data.as_buffer())
                n, ids = len(found.keys), found.ids()
                cuts = found.starts.tolist()
                sums = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(cuts, cuts[1:])]
                columns = [pa.array([path.rsplit("/", 1)[-1]] * n, pa.string()), pa.array(range(n), pa.int64()), pa.array(found.keys, pa.int64())]
                columns += [pa.array(found.starts[:-1]), pa.array(np.diff(found.starts)), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["file", "place", "key", "local", "n_tokens", "ids_crc32"])

    if manifest.isEmpty():
        return spark.createDataFrame([], f"{key} long, start long, n_tokens long, ids_crc32 long, file string, place long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.dac").load(folder).select("path", "content")
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = files.mapInArrow(read, out).join(manifest.select("file", before.alias("before")), "file")
    return rows.select(F.col("key").alias(key), (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "file", "place")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch.new_path(spark, "token_files")
    manifest = write_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return read_files(spark, folder, manifest).drop("file", "place")
