"""Operator 8, token ids in sorted-string-table shards.

A shard: magic; zstd blocks of entries sorted by key, each with the prefix it
shares with the key before; sparse index (first key, place and length of each
block); Bloom filter; footer; a line feed. Keys order by doc_id, nulls first, then by the
text's hash, then by a number that tells repeated rows apart; they ascend over all shards.
Ids are kept in 2 bytes where the vocabulary allows.

Each executor writes whole shards through Spark's text writer (one record a
file), so any file system Spark knows will do and a lost task leaves nothing. A shard
is one row, so SHARD bounds what a task holds; raise it where executors are larger.

Defined results: null text is empty; repeated rows are kept (rows alike in doc_id and
text pass through one task, shard by shard); an empty table gives no rows. Other
columns aren't read."""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.llm.common import arrow_schema, as_binary, map_arrow, materialize, new_path, runs, text_strings, tokenizer_path
from quarryline.llm.pack import encoded

MAGIC = b"QLSST01\n"
BLOCK, SHARD = 64 << 10, 4 << 20
FOOTER = struct.Struct("<QQQQQQI8s")  # index place and length, filter place and length, entries, ids, bytes an id, magic
ROWS = "first binary, doc_id long, local long, n_tokens long, ids_crc32 long"


def key_of(doc_id: int | None, text_hash: int = 0, number: int = 0) -> bytes:
    return (b"\0" + bytes(8) if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))) + struct.pack(">QI", text_hash + (1 << 63), number)


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:9])[0] - (1 << 63) if key[0] else None


def _places(key: bytes, bits: int) -> list[int]:
    a, b = xxhash.xxh64_intdigest(key[:9], 1), xxhash.xxh64_intdigest(key[:9], 2) | 1
    return [(a + i * b) % bits for i in range(7)]


class Writer:
    def __init__(self, width: int):
        self.width, self.out, self.size = width, [MAGIC], len(MAGIC)
        self.block, self.filled, self.last = [], 0, b""
        self.index, self.keys, self.ids = [], [], 0

    def add(self, key: bytes, ids: bytes) -> None:
        shared = next((i for i, (x, y) in enumerate(zip(key, self.last, strict=False)) if x != y), len(self.last)) if self.block else 0
        if not self.block:
            self.index.append((key, self.size))
        entry = struct.pack("<BBI", shared, len(key) - shared, len(ids)) + key[shared:] + ids
        self.block.append(entry)
        self.filled += len(entry)
        self.last = key
        self.keys.append(key)
        self.ids += len(ids) // self.width
        if self.filled >= BLOCK:
            self.end_block()

    def end_block(self) -> None:
        if self.block:
            data = zstandard.ZstdCompressor(level=1).compress(b"".join(self.block))
            self.out.append(data)
            self.size += len(data)
            self.block, self.filled = [], 0

    def finish(self) -> bytes:
        self.end_block()
        ends = [x[1] for x in self.index[1:]] + [self.size]
        index = b"".join(struct.pack("<21sQQ", k, at, end - at) for (k, at), end in zip(self.index, ends, strict=True))
        bits = max(64, 10 * len(self.keys) // 8 * 8 + 8)
        bloom = bytearray(bits // 8)
        for k in self.keys:
            for p in _places(k, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        footer = FOOTER.pack(self.size, len(index), self.size + len(index), len(bloom), len(self.keys), self.ids, self.width, MAGIC)
        return b"".join([*self.out, index, bytes(bloom), footer])


class Reader:
    def __init__(self, data: bytes):
        end = len(data) - (data[-9:-1] == MAGIC and data[-8:] != MAGIC)
        self.data = memoryview(data)[:end]
        at, n, self.bloom_at, self.bloom_n, self.entries, self.ids, self.width, magic = FOOTER.unpack_from(self.data, len(self.data) - FOOTER.size)
        if magic != MAGIC or self.data[:8] != MAGIC:
            raise ValueError("not a shard")
        self.index = list(struct.iter_unpack("<21sQQ", self.data[at : at + n]))

    def _block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        _, at, n = self.index[i]
        block, p, key = zstandard.ZstdDecompressor().decompress(self.data[at : at + n], max_output_size=1 << 31), 0, b""
        while p < len(block):
            shared, own, size = struct.unpack_from("<BBI", block, p)
            key = key[:shared] + block[p + 6 : p + 6 + own]
            p += 6 + own
            yield key, block[p : p + size]
            p += size

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.index)):
            yield from self._block(i)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of each row with this doc_id: filter, binary search in the index, then a scan of a block or more."""
        key, bits = key_of(doc_id, -(1 << 63)), self.bloom_n * 8
        if not all(self.data[self.bloom_at + (p >> 3)] >> (p & 7) & 1 for p in _places(key, bits)):
            return []
        out = []
        for i in range(max(0, bisect_right(self.index, key, key=lambda x: x[0]) - 1), len(self.index)):
            if self.index[i][0][:9] > key[:9]:
                break
            out += [np.frombuffer(v, f"<u{self.width}").astype("<u4") for k, v in self._block(i) if k[:9] == key[:9]]
        return out


def _write(batches: Iterator[pa.RecordBatch], path: str, width: int, shard: int) -> Iterator[pa.RecordBatch]:
    schema, writer, last, number = pa.schema([("shard", pa.binary())]), None, object(), 0
    for batch in batches:
        ids, texts = list(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)), text_strings(batch.column(1))
        for a, b in runs([len(x) for x in texts], 2_000_000):
            flat, ends = encoded(texts[a:b], path)
            data, start = flat.astype(f"<u{width}").tobytes(), 0
            for name, end in zip(ids[a:b], ends.tolist(), strict=True):
                number = number + 1 if name == last else 0
                last = name
                writer = writer or Writer(width)
                writer.add(key_of(*name, number), data[start * width : end * width])
                start = end
                if writer.size + writer.filled >= shard:
                    yield pa.RecordBatch.from_arrays([pa.array([writer.finish()], pa.binary())], schema=schema)
                    writer = None
    if writer:
        yield pa.RecordBatch.from_arrays([pa.array([writer.finish()], pa.binary())], schema=schema)


def write(documents: DataFrame, path: str, tokenizer: str, shard: int = SHARD) -> None:
    """Shards at ``path``, their keys ascending over all shards."""
    from quarryline.llm.bpe import encoder

    width = 2 if encoder(tokenizer).size <= 1 << 16 else 4
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), as_binary(), F.xxhash64("text").alias("h"))
    ordered = texts.repartitionByRange(F.col("doc_id").asc_nulls_first(), "h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h")
    shards = map_arrow(ordered, partial(_write, path=tokenizer, width=width, shard=shard), "shard binary")
    shards.select(F.col("shard").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema(ROWS)
    for batch in batches:
        for content in batch.column(0):
            if not (data := content.as_buffer()):
                continue
            reader, rows, local = Reader(data), [], 0
            for key, ids in reader:
                n = len(ids) // reader.width
                rows.append((id_of(key), local, n, zlib.crc32(np.frombuffer(ids, f"<u{reader.width}").astype("<u4"))))
                local += n
            if rows:
                doc_id, at, n, crc = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([reader.index[0][0]] * len(rows), pa.binary()), *(pa.array(x, pa.int64()) for x in (doc_id, at, n, crc))], schema=schema)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32, from the shards alone."""
    files = spark.read.format("binaryFile").load(path).select("content")
    rows = materialize(map_arrow(files, _read, ROWS), "token-rows")
    totals = rows.groupBy("first").agg(F.sum("n_tokens").alias("ids"))  # a row for each shard, named by its first key
    # prefix sums over ranges of shards, then in each range, so no task sees all shards
    ranged = materialize(totals.repartitionByRange("first").withColumn("part", F.spark_partition_id()), "shard-totals")
    parts = ranged.groupBy("part").agg(F.min("first").alias("least"), F.sum("ids").alias("all"))
    upto = parts.select("part", F.coalesce(F.sum("all").over(Window.orderBy("least").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("upto"))  # a row for each partition
    inside = F.coalesce(F.sum("ids").over(Window.partitionBy("part").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = ranged.withColumn("inside", inside).join(F.broadcast(upto), "part").select("first", (F.col("upto") + F.col("inside")).alias("before"))
    return rows.join(before, "first").select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    spark = documents.sparkSession
    path = new_path(spark, "shards")
    write(documents, path, tokenizer or tokenizer_path())
    return read(spark, path)
