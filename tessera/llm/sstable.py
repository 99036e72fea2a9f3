"""Sorted-string-table shards of token ids (operator 10).

A shard is one file that holds documents in ascending order of identifier:

    block*  index  bloom  footer  MAGIC

* block: zlib-free run of entries. Entry: shared (u16, bytes of the key that equal
  the start of the key before it in the block; 0 at every RESTART-th entry), rest
  (u16), count (u32, ids), the rest of the key, the ids (u16 each if the vocabulary
  fits, else u32). A block closes after block_bytes.
* index: for each block its last key (u16 length and bytes), offset (u64), length
  (u32), ids before it in the shard (u64) and documents before it (u64).
* bloom: bits of a Bloom filter over the keys of the shard, bloom_bits a key.
* footer: FOOTER as below. MAGIC ends every file.

Keys are 9 bytes: 0 for a null identifier, or 1 and the identifier big-endian with
its sign bit turned, so that byte order is numeric order and null comes first.

Files are written by Spark's text writer, one row a file, with MAGIC as the line
separator; so the commit protocol of the session's file system holds, a lost
executor's shard is written anew, and any store that Spark writes to will do.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import new_path, small_batches, tasks, tidy
from tessera.llm.tokens import encoder

MAGIC = b"TSSTAB1\n"
#: index offset, bloom offset, footer offset, entries, ids, blocks, bloom hashes, id width, first key, last key
FOOTER = struct.Struct("<QQQQQIHH9s9s")
ENTRY = struct.Struct("<HHI")
RESTART = 16
NULL_KEY = b"\x00" * 9


def key_of(number: int | None) -> bytes:
    return NULL_KEY if number is None else b"\x01" + struct.pack(">Q", (number + (1 << 63)) & (1 << 64) - 1)


def number_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key[0] else None


def _bits(key: bytes, hashes: int, size: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return [(a + i * b) % size for i in range(hashes)]


class ShardWriter:
    """Collects entries in ascending key order and packs them into one shard."""

    def __init__(self, width: int, block_bytes: int = 1 << 16, bloom_bits: int = 10):
        self.width, self.block_bytes, self.bloom_bits = width, block_bytes, bloom_bits
        self.blocks: list[bytes] = []
        self.block: list[bytes] = []
        self.keys: list[bytes] = []
        self.index: list[tuple] = []
        self.ids = self.offset = self.block_size = self.block_entries = 0
        self.block_ids = self.block_docs = 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        shared = 0
        if self.block_entries % RESTART:
            last = self.keys[-1]
            while shared < len(key) and key[shared] == last[shared]:
                shared += 1
        if not self.block_entries:
            self.block_ids, self.block_docs = self.ids, len(self.keys)
        entry = ENTRY.pack(shared, len(key) - shared, len(ids)) + key[shared:] + ids.astype(f"<u{self.width}").tobytes()
        self.block.append(entry)
        self.keys.append(key)
        self.ids += len(ids)
        self.block_size += len(entry)
        self.block_entries += 1
        if self.block_size >= self.block_bytes:
            self._close()

    def _close(self) -> None:
        if self.block_entries:
            raw = b"".join(self.block)
            self.index.append((self.keys[-1], self.offset, len(raw), self.block_ids, self.block_docs))
            self.blocks.append(raw)
            self.offset += len(raw)
            self.block, self.block_size, self.block_entries = [], 0, 0

    def size(self) -> int:
        return self.offset + self.block_size

    def packed(self) -> bytes:
        """The shard without the MAGIC that the writer appends."""
        self._close()
        index = b"".join(struct.pack("<H", len(k)) + k + struct.pack("<QIQQ", *rest) for k, *rest in self.index)
        bits = max(64, len(self.keys) * self.bloom_bits + 7 & ~7)
        hashes = max(1, round(self.bloom_bits * 0.69))
        bloom = np.zeros(bits, dtype=np.uint8)
        for k in set(self.keys):
            bloom[_bits(k, hashes, bits)] = 1
        packed = np.packbits(bloom).tobytes()
        footer = FOOTER.pack(self.offset, self.offset + len(index), self.offset + len(index) + len(packed), len(self.keys), self.ids, len(self.index), hashes, self.width, self.keys[0], self.keys[-1])
        return b"".join([*self.blocks, index, packed, footer])


class Shard:
    """A shard read from the bytes of its file."""

    def __init__(self, data: bytes | memoryview):
        self.data = memoryview(data)
        if bytes(self.data[-len(MAGIC) :]) != MAGIC:
            raise ValueError("not a shard: the file doesn't end in the magic number")
        at = len(self.data) - len(MAGIC) - FOOTER.size
        self.index_at, self.bloom_at, footer_at, self.entries, self.ids, self.n_blocks, self.hashes, self.width, self.first, self.last = FOOTER.unpack(self.data[at : at + FOOTER.size])
        if footer_at != at:
            raise ValueError("not a shard: its footer is not where it says")
        self.index, pos = [], self.index_at
        for _ in range(self.n_blocks):
            (n,) = struct.unpack_from("<H", self.data, pos)
            key = bytes(self.data[pos + 2 : pos + 2 + n])
            self.index.append((key, *struct.unpack_from("<QIQQ", self.data, pos + 2 + n)))
            pos += 2 + n + 28
        self.bloom_end = footer_at

    def may_hold(self, key: bytes) -> bool:
        bits = (self.bloom_end - self.bloom_at) * 8
        return all(self.data[self.bloom_at + b // 8] >> 7 - b % 8 & 1 for b in _bits(key, self.hashes, bits))

    def block(self, number: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, at, size, _, _ = self.index[number]
        end, last = at + size, b""
        while at < end:
            shared, rest, count = ENTRY.unpack_from(self.data, at)
            at += ENTRY.size
            last = last[:shared] + bytes(self.data[at : at + rest])
            at += rest
            yield last, np.frombuffer(self.data, dtype=f"<u{self.width}", count=count, offset=at)
            at += count * self.width

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for number in range(self.n_blocks):
            yield from self.block(number)

    def get(self, number: int | None) -> list[np.ndarray]:
        """The ids of every document with this identifier: Bloom filter, then binary search of the index, then its blocks."""
        key = key_of(number)
        if not self.first <= key <= self.last or not self.may_hold(key):
            return []
        low, high = 0, self.n_blocks
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.index[mid][0] < key else (low, mid)
        found = []
        while low < self.n_blocks:
            for k, ids in self.block(low):
                if k > key:
                    return found
                if k == key:
                    found.append(ids)
            low += 1
        return found


def write_shards(docs: DataFrame, path: str, tokenizer: str, *, end_id: int | None = 0, shard_bytes: int = 8 << 20, block_bytes: int = 1 << 16, bloom_bits: int = 10) -> None:
    """Encodes doc_id and text of docs and writes shards below path in ascending doc_id order.

    Texts are encoded whole as the library does by default (strings of special tokens become
    those tokens), a null text as an empty one; end_id (None: nothing) ends each
    document. Rows with equal doc_id stay beside each other, ordered by text; a null doc_id
    comes first, and documents that share an identifier are dealt out by how their texts begin. Other columns are ignored. An empty table writes no shard. A shard closes
    after shard_bytes; a task holds one shard and one text.
    """
    spark = docs.sparkSession

    def pack(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(tokenizer, special=True)
        width = 2 if max(coder.size - 1, end_id or 0) < 1 << 16 else 4
        end = np.array([] if end_id is None else [end_id], dtype="<u4").tobytes()
        shard = ShardWriter(width, block_bytes, bloom_bits)
        for batch in batches:
            for number, missing, text in zip(batch["number"], batch["missing"], batch["text"], strict=True):
                shard.add(key_of(None if missing else int(number)), np.frombuffer(coder.packed(text) + end, dtype="<u4"))
                if shard.size() >= shard_bytes:
                    yield pd.DataFrame({"value": [shard.packed()]})
                    shard = ShardWriter(width, block_bytes, bloom_bits)
        if shard.keys:
            yield pd.DataFrame({"value": [shard.packed()]})

    number = F.col("doc_id").cast("long")
    rows = docs.select(F.coalesce(number, F.lit(0)).alias("number"), number.isNull().alias("missing"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange(tasks(spark), F.desc("missing"), F.asc("number"), F.substring("text", 1, 64)).sortWithinPartitions(F.desc("missing"), F.asc("number"), F.asc("text"))
    packed = rows.mapInPandas(tidy(pack), "value binary").select(F.col("value").cast("string").alias("value"))
    with small_batches(spark):
        packed.write.option("maxRecordsPerFile", 1).option("lineSep", MAGIC.decode()).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """path and content of the shards; a task without rows can leave an empty file, which isn't one."""
    return spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """One row a document of the shards below path: doc_id, shard (first key), pos (documents before it in its shard), ids_before (ids before it in its shard), ids (little-endian unsigned 32-bit integers)."""

    def unpack(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                shard, before, pos = Shard(content), 0, 0
                for block in range(shard.n_blocks):
                    rows = []
                    for key, ids in shard.block(block):
                        rows.append((number_of(key), name, pos, before, ids.astype("<u4").tobytes()))
                        before, pos = before + len(ids), pos + 1
                    yield pd.DataFrame(rows, columns=["doc_id", "shard", "pos", "ids_before", "ids"]).astype({"doc_id": "Int64"})

    return _files(spark, path).mapInPandas(tidy(unpack), "doc_id long, shard string, pos long, ids_before long, ids binary")


def shard_footers(spark: SparkSession, path: str) -> DataFrame:
    """One row a shard: shard (its path), first_key, n_docs, n_ids, and start, the ids of all shards before it."""

    def unpack(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(name, Shard(content)) for name, content in zip(batch["path"], batch["content"], strict=True)]
            yield pd.DataFrame([(name, s.first, s.last, s.entries, s.ids) for name, s in found], columns=["shard", "first_key", "last_key", "n_docs", "n_ids"])

    rows = _files(spark, path).mapInPandas(tidy(unpack), "shard string, first_key binary, last_key binary, n_docs long, n_ids long")
    # a row for each shard of shard_bytes, so one window over all of them stays small; shards of one key come in the order of their tasks' files
    order = Window.orderBy("first_key", "last_key", "shard").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))


def token_positions(spark: SparkSession, path: str) -> DataFrame:
    """Per document, read back from the shards below path: doc_id, start (ids of all documents before it), n_tokens and ids_crc32 (unsigned, of its ids as little-endian unsigned 32-bit integers)."""

    def digests(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                shard, before = Shard(content), 0
                rows = []
                for key, ids in shard:
                    rows.append((number_of(key), name, before, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    before += len(ids)
                yield pd.DataFrame(rows, columns=["doc_id", "shard", "ids_before", "n_tokens", "ids_crc32"]).astype({"doc_id": "Int64"})

    rows = _files(spark, path).mapInPandas(tidy(digests), "doc_id long, shard string, ids_before long, n_tokens long, ids_crc32 long")
    starts = shard_footers(spark, path).select("shard", "start")
    return rows.join(starts, "shard").select("doc_id", (F.col("start") + F.col("ids_before")).alias("start"), "n_tokens", "ids_crc32")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_sstable(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Writes docs as shards of ids, each document ended by id 0, and returns what token_positions reads from them."""
    path = new_path(spark, "shards")
    write_shards(docs, path, tokenizer_path())
    return token_positions(spark, path)
