"""Token ids in sorted-string-table shards.

A shard file holds documents in ascending key order:

* data blocks of about BLOCK bytes, each zstd-compressed: entries of (shared prefix with the key before, rest of the key, number
  of ids, ids), the first entry of a block with its whole key;
* the block index: first key, offset, size and first token position of each block;
* a Bloom filter over the keys;
* a footer of fixed size: where index and filter lie, documents, tokens, width of an id, magic.

Keys are 9 bytes that sort as the identifiers do (nulls last). A lookup asks the filter, finds the block by binary search in
the index and reads that block alone.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm import files, tokens
from panelforge.session import partitions, plan_bytes, release, scratch, ship

MAGIC = b"PFSSTB01"
FOOTER = struct.Struct("<QQQQQQB8s")
BLOCK = 64 << 10
SHARD_BYTES = 128 << 20  # of the input to a shard, about
BITS_PER_KEY = 10
PROBES = 7


def key_of(doc_id: int | None) -> bytes:
    return b"\x01" + bytes(8) if doc_id is None else b"\x00" + (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key[0] else int.from_bytes(key[1:], "big") - (1 << 63)


def probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & ((1 << 64) - 1), h >> 64 | 1
    return [(a + i * b) % bits for i in range(PROBES)]


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    shift = value = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


class Writer:
    """Writes one shard; keys must come in ascending order (equal keys are kept as they come)."""

    def __init__(self, uri: str, width: int):
        self.out, self.width = files.create(uri), width
        self.block, self.block_key, self.block_first, self.last = bytearray(), None, 0, b""
        self.index: list[tuple[bytes, int, int, int]] = []
        self.at = self.documents = self.tokens = 0
        self.hashes: list[bytes] = []

    def add(self, key: bytes, ids: bytes) -> None:
        if key < self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.block_key is None:
            self.block_key, self.block_first = key, self.tokens
        else:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        n = len(ids) // self.width
        self.block += varint(shared) + varint(len(key) - shared) + key[shared:] + varint(n) + ids
        self.hashes.append(key)
        self.last = key
        self.documents += 1
        self.tokens += n
        if len(self.block) >= BLOCK:
            self.flush()

    def flush(self) -> None:
        if self.block_key is None:
            return
        data = zstandard.ZstdCompressor(level=1).compress(bytes(self.block))
        self.out.write(data)
        self.index.append((self.block_key, self.at, len(data), self.block_first))
        self.at += len(data)
        self.block, self.block_key = bytearray(), None

    def close(self) -> None:
        self.flush()
        bits = max(64, -(-len(self.hashes) * BITS_PER_KEY // 8) * 8)
        bloom = np.zeros(bits, bool)
        for key in self.hashes:
            bloom[probes(key, bits)] = True
        index = b"".join(struct.pack("<H", len(k)) + k + struct.pack("<QQQ", *rest) for k, *rest in self.index)
        bloom = np.packbits(bloom, bitorder="little").tobytes()
        self.out.write(index + bloom)
        self.out.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.documents, self.tokens, self.width, MAGIC))
        self.out.close()


class Reader:
    """One shard: lookup(doc_id), or all entries in order."""

    def __init__(self, uri: str):
        self.file = files.open_random(uri)
        size = self.file.size()
        at, n, bloom_at, bloom_n, self.documents, self.tokens, self.width, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"not a shard: {uri}")
        raw, i, self.keys, self.places = self.file.read_at(n, at), 0, [], []
        while i < n:
            (k,) = struct.unpack_from("<H", raw, i)
            self.keys.append(raw[i + 2 : i + 2 + k])
            self.places.append(struct.unpack_from("<QQQ", raw, i + 2 + k))
            i += 26 + k
        self.bloom = self.file.read_at(bloom_n, bloom_at)

    def block(self, i: int) -> Iterator[tuple[bytes, bytes, int]]:
        """Entries of a block: (key, ids, position of the first id in the shard)."""
        at, size, first = self.places[i]
        data, j, key = zstandard.decompress(self.file.read_at(size, at)), 0, b""
        while j < len(data):
            shared, j = read_varint(data, j)
            rest, j = read_varint(data, j)
            key = key[:shared] + data[j : j + rest]
            n, j = read_varint(data, j + rest)
            yield key, data[j : j + n * self.width], first
            j += n * self.width
            first += n

    def __iter__(self) -> Iterator[tuple[bytes, bytes, int]]:
        for i in range(len(self.keys)):
            yield from self.block(i)

    def lookup(self, doc_id: int | None) -> np.ndarray | None:
        """The ids of a document, or None; of equal keys the first."""
        key = key_of(doc_id)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in probes(key, len(self.bloom) * 8)):
            return None
        i = max(0, bisect.bisect_left(self.keys, key) - 1)
        while i < len(self.keys) and self.keys[i] <= key:
            for found, ids, _ in self.block(i):
                if found == key:
                    return np.frombuffer(ids, f"<u{self.width}")
            i += 1
        return None


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes whole texts and writes a shard per range of identifiers; returns the manifest.

    The manifest has shard (its number in key order), path, documents and tokens. Shards are ranges of the identifier, so their
    order is the order of identifiers. A task that is run again writes another file and the manifest names one of them.
    A null or empty text has no ids but the end id. Null identifiers come last. Rows with one identifier are all kept, in
    the order of their texts, and share a shard. Extra columns are ignored. An empty table gives an empty manifest.
    """
    spark = ship(docs.sparkSession)

    def shard(batches):
        writer, path, number = None, None, 0
        code = tokens.encoder(vocabulary)
        end = np.array([] if end_id is None else [end_id], code.type)
        for batch in batches:
            coded = code.encode(batch.column("text").to_pylist())
            for doc_id, ids, number in zip(batch.column("id").to_pylist(), coded, batch.column("shard").to_pylist(), strict=True):
                if writer is None:
                    path = files.fresh(folder, ".sst")
                    writer = Writer(path, code.type.itemsize)
                writer.add(key_of(doc_id), np.concatenate([ids, end]).tobytes())
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"shard": [number], "path": [path], "documents": [writer.documents], "tokens": [writer.tokens]})
        release()

    schema = "shard long, path string, documents long, tokens long"
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    shards = max(4 * partitions(spark), (plan_bytes(docs) or 0) // SHARD_BYTES)
    ranged = source.repartitionByRange(shards, F.col("id").asc_nulls_last())
    ranged = ranged.withColumn("shard", F.spark_partition_id()).sortWithinPartitions(F.col("id").asc_nulls_last(), "text")
    manifest = ranged.mapInArrow(shard, schema)
    path = f"{folder.rstrip('/')}/manifest"
    manifest.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def crc32(ids: bytes, width: int) -> int:
    """Unsigned, of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes())


def scan(manifest: DataFrame, column: str, kind: pa.DataType, sql: str, of) -> DataFrame:
    """All documents of all shards: doc_id, start (ids of all documents before it), n_tokens and `column`, of(ids, width)."""
    spark = ship(manifest.sparkSession)
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard: small at any size of the corpus
    based = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(order), F.lit(0)))

    def pack(rows):
        types = [pa.int64(), pa.int64(), pa.int64(), kind]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "start", "n_tokens", column])

    def entries(batches):
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                rows, size, shard = [], 0, Reader(path)
                for key, ids, first in shard:
                    rows.append((id_of(key), base + first, len(ids) // shard.width, of(ids, shard.width)))
                    size += len(ids)
                    if size > 4 << 20:
                        yield pack(rows)
                        rows, size = [], 0
                if rows:
                    yield pack(rows)

    placed = based.repartition(partitions(spark))
    return placed.mapInArrow(entries, f"doc_id long, start long, n_tokens long, {column} {sql}")


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids of all documents."""
    return scan(manifest, "ids", pa.list_(pa.int64()), "array<long>", lambda ids, width: np.frombuffer(ids, f"<u{width}"))


def checksums(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of all documents."""
    return scan(manifest, "ids_crc32", pa.int64(), "long", crc32)


def store(docs: DataFrame, vocabulary: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """write() into a new shared folder."""
    return write(docs, scratch(docs.sparkSession, "sstable"), vocabulary, end_id, id_col, text_col)
