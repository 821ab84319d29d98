"""Token-ID output: sorted-string-table shards of documents keyed by identifier.

Documents are range-partitioned by identifier and sorted; every task writes shards that hold, in key order,
prefix-compressed blocks of (key, token ids), a sparse index with the last key of each block, a Bloom filter over the
keys and a footer. A lookup reads the footer, asks the Bloom filter, finds the block by binary search in the index and
scans that one block.

File: blocks | index | bloom | footer. A block is a run of entries: u16 shared key bytes, u16 own key bytes, u32 token
count, own key bytes, ids. Ids take two bytes where the vocabulary fits, else four, little-endian. The index has
u16 key length, last key, u64 offset, u32 length, u32 entries per block. The footer is FOOTER.

Keys are one byte (1: id, 2: null) and the id as 8 big-endian bytes with the sign bit turned, so byte order is numeric
order and null comes last. Repeated ids are kept side by side, in the order of their texts."""

from __future__ import annotations

import bisect
import functools
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram.llm.common import cut, filesystem, fresh_path, owned

FOOTER = struct.Struct("<QQQIQQBQ8s")  # index offset, bloom offset, bloom bytes, blocks, documents, ids, id width, first row, magic
MAGIC = b"ENGRSST1"
BLOCK_BYTES = 1 << 16
BLOOM_BITS_PER_KEY, BLOOM_HASHES = 10, 7


def key_of(doc_id: int | None) -> bytes:
    return b"\x02" if doc_id is None else b"\x01" + struct.pack(">Q", doc_id + 2**63)


def id_of(key: bytes) -> int | None:
    return None if key == b"\x02" else struct.unpack(">Q", key[1:])[0] - 2**63


def _bloom_places(key: bytes, bits: int) -> list[int]:
    a, b = xxhash.xxh64_intdigest(key), xxhash.xxh64_intdigest(key, 1) | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class Pieces(dict):
    """Ids of words; holds at most twice LIMIT of them, and those that were not asked for of late go first."""

    LIMIT = 350_000

    def __init__(self, ids, ids_of_lines):
        self.ids, self.ids_of_lines, self.before = ids, ids_of_lines, {}

    def __missing__(self, word: str) -> bytes:
        if "\n" in word:  # nearly unique, so not kept
            return self.ids_of_lines(word, self)
        if len(self) >= self.LIMIT:
            self.before = dict(self)
            self.clear()
        out = self[word] = self.before.get(word) or self.ids(word)
        return out


class Encoder:
    """Texts to ids by the tokenizers library; equal pieces of text are encoded once.

    The byte-level pre-tokenizer never joins text across a space that follows a text without other white space around
    it, so a text may be cut before its spaces and the pieces encoded apart; likewise at a line end between two pieces
    without white space beside it. Texts with a space between white space, or with a special token, go to the library
    whole."""

    whole = re.compile(r"\s \s|<\|")

    def __init__(self, vocabulary: str, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(vocabulary), struct.pack("<I", end_id)
        self.model = self.tokenizer.model
        own = {*range(33, 127), *range(161, 173), *range(174, 256)}  # bytes that stand for themselves; the others follow from 256 on
        self.alphabet = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in own)}
        self.marks = dict(zip(".,!?;:", self._batch(list(".,!?;:"))))
        self.line_end = self._batch(["\n"])[0]
        self.cuttable, self.lines = self._cut("a b") == ["a", "Ġb"] and self.tokenizer.normalizer is None, self._cut("a.\nb") == ["a", ".", "Ċ", "b"]
        self.bare = Pieces(lambda x: self._word(x, self.bare, ""), self._of_lines)
        self.spaced = Pieces(lambda x: self._word(x, self.spaced, " "), self._of_lines)

    def _cut(self, text: str) -> list[str]:
        return [x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)] if self.tokenizer.pre_tokenizer else []

    def _batch(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str, known: Pieces, before: str) -> bytes:
        """Of a word and what is before it: letters are one piece for the model, in its alphabet of bytes."""
        if word.isalpha():
            spelt = word if word.isascii() else word.encode().decode("latin-1").translate(self.alphabet)
            return array("I", [t.id for t in self.model.tokenize("Ġ" + spelt if before else spelt)]).tobytes()
        if word[-1:] in self.marks and word[:-1].isalpha():  # the word and the mark are encoded apart
            return known[word[:-1]] + self.marks[word[-1]]
        return self._batch([before + word])[0]

    def _of_lines(self, word: str, known: Pieces) -> bytes:
        first, *rest = word.split("\n")
        if self.lines and all(x and x == x.strip() for x in (first, *rest)):
            return self.line_end.join([known[first], *map(self.bare.__getitem__, rest)])
        return self._batch([(" " if known is self.spaced else "") + word])[0]

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian u32, with the end id."""
        out: list[bytes] = []
        of = self.spaced.__getitem__
        for text in texts:
            if text and self.cuttable and not self.whole.search(text):
                first, *rest = text.split(" ")
                out.append(b"".join([self.bare[first] if first else b"", *map(of, rest), self.end]))
            else:
                out.append((self._batch([text])[0] if text else b"") + self.end)
        return out


@functools.lru_cache(1)
def _encoder(vocabulary: str, end_id: int) -> Encoder:
    return Encoder(vocabulary, end_id)


class ShardWriter:
    def __init__(self, stream, width: int):
        self.out, self.width = stream, width
        self.at = self.docs = self.ids = 0
        self.block, self.size, self.entries, self.last = [], 0, 0, b""
        self.index: list[tuple[bytes, int, int, int]] = []
        self.keys: list[bytes] = []

    def add(self, key: bytes, ids: np.ndarray) -> None:
        same = 0
        if self.entries:
            while same < len(key) and same < len(self.last) and key[same] == self.last[same]:
                same += 1
        body = ids.astype(f"<u{self.width}").tobytes()
        self.block += [struct.pack("<HHI", same, len(key) - same, len(ids)), key[same:], body]
        self.size += 8 + len(key) - same + len(body)
        self.entries, self.last = self.entries + 1, key
        self.docs, self.ids = self.docs + 1, self.ids + len(ids)
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        if self.size >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.entries:
            self.out.write(b"".join(self.block))
            self.index.append((self.last, self.at, self.size, self.entries))
            self.at += self.size
            self.block, self.size, self.entries = [], 0, 0

    def close(self) -> None:
        self._flush()
        index = b"".join(struct.pack("<H", len(k)) + k + struct.pack("<QII", *rest) for k, *rest in self.index)
        bits = max(64, len(self.keys) * BLOOM_BITS_PER_KEY)
        bloom = np.zeros(bits, bool)
        for k in self.keys:
            bloom[_bloom_places(k, bits)] = True
        packed = struct.pack("<Q", bits) + np.packbits(bloom, bitorder="little").tobytes()
        self.out.write(index + packed)
        self.out.write(FOOTER.pack(self.at, self.at + len(index), len(packed), len(self.index), self.docs, self.ids, self.width, 0, MAGIC))
        self.out.close()


class Shard:
    """A shard opened for reading; only the asked-for blocks are read."""

    def __init__(self, path: str):
        fs, at = filesystem(path)
        self.file = fs.open_input_file(at)
        size = self.file.size()
        self.index_at, bloom_at, bloom_bytes, _, self.docs, self.ids, self.width, _, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no shard")
        raw, self.index, i = self.file.read_at(bloom_at - self.index_at, self.index_at), [], 0
        while i < len(raw):
            n = struct.unpack_from("<H", raw, i)[0]
            self.index.append((raw[i + 2 : i + 2 + n], *struct.unpack_from("<QII", raw, i + 2 + n)))
            i += 2 + n + 16
        packed = self.file.read_at(bloom_bytes, bloom_at)
        self.bits, self.bloom = struct.unpack_from("<Q", packed)[0], packed[8:]

    def _block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, at, size, entries = self.index[k]
        raw, i, key = self.file.read_at(size, at), 0, b""
        for _ in range(entries):
            same, own, n = struct.unpack_from("<HHI", raw, i)
            key = key[:same] + raw[i + 8 : i + 8 + own]
            i += 8 + own
            yield key, np.frombuffer(raw, f"<u{self.width}", n, i)
            i += n * self.width

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.index)):
            for key, ids in self._block(k):
                yield id_of(key), ids

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of all rows with this identifier."""
        key = key_of(doc_id)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(key, self.bits)):
            return []
        out, k = [], bisect.bisect_left(self.index, key, key=lambda x: x[0])
        while k < len(self.index):
            rows = list(self._block(k))
            out += [ids for x, ids in rows if x == key]
            if rows[-1][0] > key:
                break
            k += 1
        return out


MANIFEST = T.StructType([T.StructField("path", T.StringType()), T.StructField("first", T.BinaryType()), T.StructField("last", T.BinaryType()), T.StructField("part", T.LongType()), T.StructField("no", T.LongType()), T.StructField("docs", T.LongType()), T.StructField("ids", T.LongType())])


def write_shards(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 0, shard_ids: int = 1 << 25, parts: int | None = None) -> DataFrame:
    """Writes docs(doc_id, text) as shards in ascending doc_id order; returns the manifest, one row per shard, in order.

    Null text counts as empty; other columns are ignored. Shard names carry a random part, so a task that runs again
    writes other files, and only those in the committed manifest count. The manifest has a row per 32 million ids."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    by_id, by_text = F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first()
    ranges = [by_id, F.substring("text", 1, 64).asc_nulls_first()]  # the driver samples these: no whole texts
    ranged = rows.repartitionByRange(*([parts] if parts else []), *ranges).sortWithinPartitions(by_id, by_text)

    def write(batches):
        from pyspark import TaskContext

        enc, part, no, w, path, first = _encoder(vocabulary, end_id), TaskContext.get().partitionId(), 0, None, "", b""
        width = 2 if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        fs, at = filesystem(folder)
        fs.create_dir(at)

        def done():
            w.close()
            return pa.RecordBatch.from_pylist([{"path": path, "first": first, "last": w.last, "part": part, "no": no, "docs": w.docs, "ids": w.ids}])

        def encoded(batch):
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                yield from zip(part.column("doc_id").to_pylist(), enc.ids(part.column("text").to_pylist()))

        for batch in batches:
            for doc_id, ids in encoded(batch):
                key = key_of(doc_id)
                if w and w.ids >= shard_ids:
                    yield done()
                    w, no = None, no + 1
                if w is None:
                    name = f"shard-{part:06d}-{no:04d}-{uuid.uuid4().hex}.sst"
                    path, first = f"{folder}/{name}", key
                    w = ShardWriter(fs.open_output_stream(f"{at}/{name}"), width)
                w.add(key, np.frombuffer(ids, "<u4"))
        if w:
            yield done()

    manifest, path = cut(ranged.mapInArrow(write, MANIFEST), "manifest")
    return manifest.orderBy("part", "no")


ROW = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def read_shards(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """A row per document from the shards: doc_id, start, n_tokens, ids_crc32. The manifest is small: a row per shard."""
    start, rows = 0, []
    for m in manifest.collect():
        rows.append((m.path, start))
        start += m.ids
    if not rows:
        return spark.createDataFrame([], ROW)
    todo = spark.createDataFrame(rows, "path string, base long").repartition(len(rows), "path")

    def read(batches):
        for batch in batches:
            for path, base in zip(*(batch.column(c).to_pylist() for c in ("path", "base"))):
                out = []
                for doc_id, ids in Shard(path):
                    out.append((doc_id, base, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    base += len(ids)
                    if len(out) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=ROW.names)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=ROW.names)

    return todo.mapInArrow(read, ROW)


def encode_and_store(docs: DataFrame, vocabulary: str, folder: str | None = None) -> DataFrame:
    """Writes the shards and reads them back; a folder that isn't named goes with the driver's JVM."""
    spark = docs.sparkSession
    named, folder = folder, folder or fresh_path(spark, "shards")
    manifest = write_shards(docs, folder, vocabulary)
    if not named:
        owned(spark, folder)
    return read_shards(spark, manifest)
