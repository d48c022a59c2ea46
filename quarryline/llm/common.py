"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Collection, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. It is the one that the
    session names in ``spark.checkpoint.dir``; only a local session without
    that setting gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="quarryline-")
    spark.sparkContext.setCheckpointDir(own)
    return own


_written: list[tuple[SparkSession, str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/quarryline/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(release)
    _written.append((spark, path))
    return path


def release() -> None:
    """Delete all tables that ``materialize`` and ``new_path`` made. Results
    that still read them can't be computed again afterwards."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm, sc = spark._jvm, spark.sparkContext._jsc
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may be gone already
            continue


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the
    lineage, and survives the loss of any executor."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_schema(spec: str) -> pa.Schema:
    """Arrow schema of a DDL string of flat columns."""
    kinds = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    parts = [x.split() for x in spec.split(",")]
    return pa.schema([(name, kinds[kind]) for name, kind in parts])


#: Bytes of an Arrow batch: a worker holds a batch, copies of it and what comes of it, so Spark's own 64 MB are too many.
BATCH_BYTES, SPARKS_OWN = "4m", str(64 << 20) + "b"


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], spec: str | T.StructType) -> DataFrame:
    """mapInArrow in batches of BATCH_BYTES, unless the session has a bound of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key, SPARKS_OWN) == SPARKS_OWN:
        df.sparkSession.conf.set(key, BATCH_BYTES)
    return df.mapInArrow(partial(_tidied, f), spec)


def _tidied(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Workers outlive their tasks; what a task has freed goes back to the machine."""
    try:
        yield from f(batches)
    finally:
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)


def free_name(taken: Collection[str], name: str) -> str:
    """A column name that no column has, in any case."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def text_bytes(column: pa.Array) -> list[bytes]:
    """Texts of a binary column; null counts as empty."""
    return [x or b"" for x in column.to_pylist()]


def text_strings(column: pa.Array) -> list[str]:
    return [(x or b"").decode("utf-8", "replace") for x in column.to_pylist()]


def as_binary(name: str = "text") -> Column:
    return F.col(name).cast("binary").alias(name)


def runs(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of consecutive items with a total size of about ``most``;
    a larger item is alone in its range."""
    a = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)


def crc_mod(column: str, by: int) -> Column:
    """crc32 of a column's text form, modulo ``by``. Null counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(by))


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


BASE = 0x9E3779B97F4A7C15
#: Codes hashed together; longer spans are hashed piece by piece.
PIECE = 1 << 18


@lru_cache(1)
def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        steps = np.full(PIECE + 1, base, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def _sums(codes: np.ndarray) -> np.ndarray:
    terms = codes.astype(np.uint64)
    terms += np.uint64(1)
    terms *= powers()[0][: len(codes)]
    return np.append(np.uint64(0), np.cumsum(terms))


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each codes[start:end], from prefix sums of a polynomial. Spans ascend and don't overlap."""
    out, a, down = np.empty(len(starts), np.uint64), 0, powers()[1]
    while a < len(starts):
        low = int(starts[a])
        b = int(np.searchsorted(ends, low + PIECE, "right"))
        if b > a:
            sums, s, e = _sums(codes[low : int(ends[b - 1])]), starts[a:b] - low, ends[a:b] - low
            out[a:b] = (sums[e] - sums[s]) * down[s]
        else:
            b, total = a + 1, 0
            for i in range(low, int(ends[a]), PIECE):
                total += int(_sums(codes[i : min(i + PIECE, int(ends[a]))])[-1]) * pow(BASE, i - low, 1 << 64)
            out[a] = total % (1 << 64)
        a = b
    return mixed(out + (ends - starts).astype(np.uint64))


#: Bytes of words: digits, letters (lower-cased), and all of non-ASCII characters; others are 0.
WORD_BYTES = np.zeros(256, np.uint8)
WORD_BYTES[48:58] = np.arange(48, 58)
WORD_BYTES[97:123] = np.arange(97, 123)
WORD_BYTES[65:91] = np.arange(97, 123)
WORD_BYTES[128:] = np.arange(128, 256)


def word_hashes(texts: list[bytes], table: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of all texts, and the number of words of each text. table: what each byte counts as, 0 if no word has it."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = table[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    edges = np.flatnonzero(np.diff((codes > 0).view(np.int8), prepend=np.int8(0)))
    starts, ends = edges[0::2], edges[1::2]  # a line feed is at the end, so each word has an end
    upto = np.searchsorted(starts, np.cumsum(sizes + 1))
    return span_hashes(codes, starts, ends), np.diff(upto, prepend=0)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
