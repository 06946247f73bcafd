r"""Token ids in sorted-string-table shards.

A shard holds the documents of one range of identifiers, in ascending order:

    data blocks   n entries; an entry is: bytes shared with the key before it,
                  length of the rest of the key, length of the value, rest, value;
                  then the crc32 of the block
    index block   first key, last key, offset and length of every data block
    Bloom filter  number of hashes, then the bits
    footer        FOOTER, of fixed size, ending in MAGIC

Lengths are variable-byte integers. Every part is followed by one byte 0x0A, so
that Spark's own file writer, and its commit protocol, can write shards to any
store. A key is the identifier with its sign flipped, in eight bytes, big-endian;
a null identifier is the empty key. A value is the start of the document's ids,
counted within the shard, and the ids in two or four bytes each.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewell.llm.common import materialize, scratch_path, table, text_batches, text_slices

MAGIC = b"tw-sst-1"
#: Index offset and length, Bloom offset and length, documents, ids, bytes an id, shard number, magic.
FOOTER = struct.Struct("<QQQQQQIQ8s")
BLOCK_BYTES = 1 << 16
#: Text that one shard takes, about; a longer document makes a larger shard.
SHARD_TEXT_BYTES = 12 << 20
BITS_A_KEY = 10
#: Words that a worker remembers, and the longest of them.
REMEMBERED, LONGEST_KEPT = 250_000, 48


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        at += 1
        n |= (byte & 127) << shift
        if byte < 128:
            return n, at
        shift += 7


def _bloom_places(key: bytes, n_hashes: int, n_bits: int) -> list[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return [(a + i * (b | 1)) % n_bits for i in range(n_hashes)]


class ShardWriter:
    """Makes the parts of one shard from documents in ascending order of their keys."""

    def __init__(self, number: int, id_bytes: int, block_bytes: int = BLOCK_BYTES) -> None:
        self.number, self.id_bytes, self.block_bytes = number, id_bytes, block_bytes
        self.offset = self.n_docs = self.n_ids = 0
        self.index: list[tuple[bytes, bytes, int, int]] = []
        self.keys: list[bytes] = []
        self._new_block()

    def _new_block(self) -> None:
        self.body, self.n, self.first, self.last = bytearray(), 0, b"", b""

    def add(self, key: bytes, ids: np.ndarray) -> Iterator[bytes]:
        """Takes a document; yields a block once it is full."""
        shared = 0
        if self.n:
            shared = len(os.path.commonprefix([self.last, key]))
        else:
            self.first = key
        value = _varint(self.n_ids) + ids.astype(f"<u{self.id_bytes}").tobytes()
        self.body += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last, self.n = key, self.n + 1
        self.n_docs, self.n_ids = self.n_docs + 1, self.n_ids + len(ids)
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        if len(self.body) >= self.block_bytes:
            yield self._close_block()

    def _part(self, data: bytes) -> bytes:
        self.offset += len(data) + 1
        return data

    def _close_block(self) -> bytes:
        data = _varint(self.n) + bytes(self.body)
        data += struct.pack("<I", zlib.crc32(data))
        self.index.append((self.first, self.last, self.offset, len(data)))
        self._new_block()
        return self._part(data)

    def finish(self) -> Iterator[bytes]:
        if self.n:
            yield self._close_block()
        index = b"".join(_varint(len(a)) + a + _varint(len(b)) + b + _varint(at) + _varint(n) for a, b, at, n in self.index)
        index_at = self.offset
        yield self._part(index)
        n_bits = max(64, BITS_A_KEY * len(self.keys))
        n_hashes = max(1, round(BITS_A_KEY * math.log(2)))
        bits = np.zeros(n_bits, np.uint8)
        for key in self.keys:
            bits[_bloom_places(key, n_hashes, n_bits)] = 1
        bloom, bloom_at = struct.pack("<IQ", n_hashes, n_bits) + np.packbits(bits).tobytes(), self.offset
        yield self._part(bloom)
        yield self._part(FOOTER.pack(index_at, len(index), bloom_at, len(bloom), self.n_docs, self.n_ids, self.id_bytes, self.number, MAGIC))


class Shard:
    """A shard's bytes: ordered reading, and lookup by binary search."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        footer = data[-1 - FOOTER.size : -1]
        index_at, index_n, self.bloom_at, self.bloom_n, self.n_docs, self.n_ids, self.id_bytes, self.number, magic = FOOTER.unpack(footer)
        if magic != MAGIC:
            raise ValueError("this isn't a shard")
        self.index: list[tuple[bytes, bytes, int, int]] = []
        at = index_at
        while at < index_at + index_n:
            keys = []
            for _ in range(2):
                n, at = _read_varint(data, at)
                keys.append(bytes(data[at : at + n]))
                at += n
            offset, at = _read_varint(data, at)
            length, at = _read_varint(data, at)
            self.index.append((keys[0], keys[1], offset, length))
        self._lasts = [x[1] for x in self.index]

    def _block(self, offset: int, length: int) -> Iterator[tuple[bytes, int, np.ndarray]]:
        data = self.data[offset : offset + length]
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("a block is damaged")
        n, at = _read_varint(data, 0)
        key = b""
        for _ in range(n):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + bytes(data[at : at + rest])
            at += rest
            start, ids_at = _read_varint(data, at)
            yield key, start, np.frombuffer(data, f"<u{self.id_bytes}", (at + size - ids_at) // self.id_bytes, ids_at)
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, int, np.ndarray]]:
        for _, _, offset, length in self.index:
            yield from self._block(offset, length)

    def may_hold(self, key: bytes) -> bool:
        n_hashes, n_bits = struct.unpack_from("<IQ", self.data, self.bloom_at)
        return all(self.data[self.bloom_at + 12 + (p >> 3)] >> (7 - (p & 7)) & 1 for p in _bloom_places(key, n_hashes, n_bits))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document of that identifier in this shard."""
        key, found = key_of(doc_id), []
        if not self.may_hold(key):
            return found
        k = bisect.bisect_left(self._lasts, key)
        while k < len(self.index) and self.index[k][0] <= key:
            found += [ids for x, _, ids in self._block(*self.index[k][2:]) if x == key]
            k += 1
        return found


#: Letters of Latin-1, in lower case, as the tokenizer's pattern takes them.
LETTERS = "a-zªµºßà-öø-ÿ"
PARTS = re.compile(f"[{LETTERS}]+|[^{LETTERS} \n]+")
WORD = re.compile(f"[{LETTERS}]+")


class WordCache:
    """Encodes texts exactly as the library does, each distinct word once.

    The tokenizer drops white space, and neither its splitting, its normaliser nor
    its special strings reach across it, so the runs between spaces and line ends
    are independent. In a text of Latin-1 characters without apostrophe or special
    string, lower case is the whole normalisation, and a run of letters is one
    word for the model; what stands between such words, and all runs of any other
    text, goes to the library unchanged. The table is emptied when it is full.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.id_bytes = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.id_bytes}"
        self.known: dict[str, bytes] = {"": b""}
        # The model reads bytes as characters: printable ones as themselves, others in order from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [x for x in range(256) if x not in plain]
        self.alphabet = {x: 256 + i for i, x in enumerate(rest)}

    def _split(self, text: str) -> list[str]:
        if "'" not in text and "<|" not in text:
            try:
                text.encode("latin-1")
                return PARTS.findall(text.lower())
            except UnicodeEncodeError:
                pass
        return text.replace("\n", " ").split(" ")

    def _learn(self, fresh: list[str]) -> None:
        known, others, pack = self.known, [], struct.Struct
        one, tokenize = "H" if self.id_bytes == 2 else "I", self.tokenizer.model.tokenize
        for run in fresh:
            if WORD.fullmatch(run):
                ids = [t.id for t in tokenize(run if run.isascii() else run.encode().decode("latin-1").translate(self.alphabet))]
                known[run] = pack(f"<{len(ids)}{one}").pack(*ids)
            else:
                others.append(run)
        for at in range(0, len(others), 8192):
            part = others[at : at + 8192]
            known.update((run, np.array(e.ids, self.kind).tobytes()) for run, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > REMEMBERED:
            self.known = {"": b""}
        known = self.known
        split = [self._split(t) for t in texts]
        fresh = list(set().union(*split).difference(known))
        self._learn(fresh)
        found = [np.frombuffer(b"".join(map(known.__getitem__, run)), self.kind) for run in split]
        for run in fresh:
            if len(run) > LONGEST_KEPT:
                del known[run]
        return found


_caches: dict[str, WordCache] = {}


def word_cache(path: str) -> WordCache:
    if path not in _caches:
        _caches[path] = WordCache(path)
    return _caches[path]


def write_shards(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, shard_text_bytes: int = SHARD_TEXT_BYTES) -> None:
    """Encode every whole text, append end_id, and write the shards to path.

    Null and empty texts hold the end id alone. A null doc_id comes first. Rows of
    one doc_id stay apart, ordered by a hash of the text, and may span shards. An
    empty table writes no shard. Other columns are not read.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = slim.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = slim.repartitionByRange(max(1, math.ceil(size / shard_text_bytes)), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_cache(tokenizer_path)
        writer = ShardWriter(TaskContext.get().partitionId(), cache.id_bytes)
        for part, texts in text_slices(batches, 1):
            blocks = []
            for doc_id, ids in zip(part.column(0).to_pylist(), cache.encode(texts), strict=True):
                blocks += writer.add(key_of(doc_id), np.append(ids, np.array([end_id], ids.dtype)))
            if blocks:
                yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.binary())], ["part"])
        if writer.n_docs:
            yield pa.RecordBatch.from_arrays([pa.array(list(writer.finish()), pa.binary())], ["part"])

    # The text writer puts a string's bytes into the file as they are, and the separator after them.
    text_batches(dealt).mapInArrow(run, "part binary").select(F.col("part").cast("string")).write.option("lineSep", "\n").text(path)


def read_shards(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Rows (shard, doc_id, shard_start, n_tokens, ids_crc32, ids) of all documents in shards; ids is null unless with_ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                if raw := data.as_py():
                    shard = Shard(raw)
                    for chunk in _chunks(shard, 1024):
                        yield _rows(chunk, shard.number)

    def _rows(chunk: list, number: int) -> pa.RecordBatch:
        ids = pa.array([x[2].astype("<i4") if with_ids else None for x in chunk], pa.list_(pa.int32()))
        columns = [[number] * len(chunk), [id_of(x[0]) for x in chunk], [x[1] for x in chunk], [len(x[2]) for x in chunk], [zlib.crc32(x[2].astype("<u4").tobytes()) for x in chunk]]
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in columns), ids], ["shard", "doc_id", "shard_start", "n_tokens", "ids_crc32", "ids"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "shard long, doc_id long, shard_start long, n_tokens long, ids_crc32 long, ids array<int>")


def _chunks(rows: Iterable, n: int) -> Iterator[list]:
    part = []
    for row in rows:
        part.append(row)
        if len(part) == n:
            yield part
            part = []
    if part:
        yield part


def look_up(spark: SparkSession, path: str, wanted: list[int]) -> DataFrame:
    """Rows (doc_id, ids) of a short list of identifiers, by Bloom filter and binary search in every shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                raw = data.as_py()
                shard = Shard(raw) if raw else None
                hits = [(i, ids.tolist()) for i in wanted for ids in (shard.get(i) if shard else ())]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in hits], pa.int64()), pa.array([x[1] for x in hits], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "doc_id long, ids array<int>")


def with_starts(rows: DataFrame) -> DataFrame:
    """Rows of read_shards() with start: the ids of all documents before, over all shards.

    One sum a shard is ordered by one task; documents are not.
    """
    rows = materialize(rows, "shard-rows")
    sums = rows.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return rows.join(bases, "shard").withColumn("start", F.col("_base") + F.col("shard_start")).drop("_base")


def op3_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of whole documents by word_bpe_49k.json, written to shards and read back."""
    import public_tokenizers

    path = scratch_path(spark, "shards")
    write_shards(table(spark, sf_dir, "documents", "doc_id", "text"), path, public_tokenizers.path("word_bpe_49k.json"))
    return with_starts(read_shards(spark, path, with_ids=False)).select("doc_id", "start", "n_tokens", "ids_crc32")
