"""Operator 2, best-fit packing.

Documents are tokenized where they are read and cut into pieces of at most
``limit`` tokens. Full pieces are sequences of their own. The others are dealt
over partitions by a hash and packed there by best fit, largest first; nearly full
bins are done. Underfull bins are the items of the next round, over a partition for
each ``per_task`` of them, until one partition packs what is left. A round that
leaves over nine tenths of its bins underfull (items of over half a sequence fit with
none) is the last one, so no task ever gets more than about ``per_task`` items.

Defined results: null text is empty, and an empty document is its end id alone.
Repeated rows are packed as often as they occur. An empty table gives no rows.
Ties go to the smaller item number, so that a lost task comes out alike again."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.bpe import encoder
from quarryline.llm.common import arrow_schema, as_binary, map_arrow, materialize, runs, text_strings, tokenizer_path

LIMIT = 2048
END_ID = 0
PER_TASK = 50_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def encoded(texts: list[str], path: str, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each with the end id, and where each text ends."""
    ids, counts = encoder(path).encode(texts)
    ends = np.cumsum(counts)
    return np.insert(ids, ends, end_id).astype("<u4"), ends + np.arange(1, len(texts) + 1)


def _cut(batches: Iterator[pa.RecordBatch], path: str, limit: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema(PIECES + (", ids binary" if with_ids else ""))
    for batch in batches:
        texts = text_strings(batch.column(1))
        for a, b in runs([len(x) for x in texts], 4_000_000):
            ids, ends = encoded(texts[a:b], path)
            starts = np.append(0, ends[:-1])
            n = ends - starts
            parts = -(-n // limit)
            which = np.repeat(np.arange(b - a), parts)
            piece = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
            stop = n[which] - (parts[which] - 1 - piece) * limit
            start = np.maximum(0, stop - limit)
            data = memoryview(ids.tobytes())
            spans = [data[4 * x : 4 * y] for x, y in zip((starts[which] + start).tolist(), (starts[which] + stop).tolist(), strict=True)]
            columns = [batch.column(0).slice(a, b - a).take(pa.array(which)), piece.astype(np.int32), start, stop - start, np.fromiter(map(zlib.crc32, spans), np.int64, len(spans))]
            columns += [pa.array(list(map(bytes, spans)), pa.binary())] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in columns], schema=schema)


def pieces(documents: DataFrame, path: str, limit: int = LIMIT, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, and the ids if asked for."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), as_binary())
    return map_arrow(texts, partial(_cut, path=path, limit=limit, with_ids=with_ids), PIECES + (", ids binary" if with_ids else ""))


def best_fit(sizes: np.ndarray, capacity: int) -> list[int]:
    """The bin of each item, for items in the order given: the fullest bin with
    room for it, or a new one. A bit of ``open_`` stands for each room left."""
    at: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_, bins, out = 0, 0, []
    for size in sizes.tolist():
        if room := open_ >> size:
            left = size + (room & -room).bit_length() - 1
            number = at[left].pop()
            if not at[left]:
                open_ &= ~(1 << left)
        else:
            left, number = capacity, bins
            bins += 1
        out.append(number)
        left -= size
        if not at[left]:
            open_ |= 1 << left
        at[left].append(number)
    return out


BIN = "bin long, size long, items binary, done boolean"
ITEM = np.dtype([("item", "<i8"), ("size", "<i8")])


def _pack(batches: Iterator[pa.RecordBatch], capacity: int, slack: int) -> Iterator[pa.RecordBatch]:
    """A task's bins as items into new bins. A bin's name is its smallest item."""
    names, sizes, members = [], [], []
    for batch in batches:
        names += batch.column(0).to_pylist()
        sizes += batch.column(1).to_pylist()
        members += batch.column(2).to_pylist()
    if not names:
        return
    name, size = np.array(names, np.int64), np.array(sizes, np.int64)
    order = np.lexsort((name, -size))
    where: dict[int, list[int]] = {}
    for i, number in zip(order.tolist(), best_fit(size[order], capacity), strict=True):
        where.setdefault(number, []).append(i)
    found = list(where.values())
    total = [int(size[x].sum()) for x in found]
    for a in range(0, len(found), 10_000):
        part = found[a : a + 10_000]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([int(name[x].min()) for x in part], pa.int64()),
                pa.array(total[a : a + 10_000], pa.int64()),
                pa.array([b"".join(members[i] for i in x) for x in part], pa.binary()),
                pa.array([capacity - n <= slack for n in total[a : a + 10_000]], pa.bool_()),
            ],
            schema=arrow_schema(BIN),
        )


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [np.frombuffer(x, ITEM) for x in batch.column(1).to_pylist()]
        if parts:
            counts = [len(x) for x in parts]
            offsets = [np.cumsum(x["size"]) - x["size"] for x in parts]
            columns = [np.concatenate([x["item"] for x in parts]), np.repeat(batch.column(0).to_numpy(zero_copy_only=False), counts), np.concatenate(offsets)]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], schema=arrow_schema("item long, sequence_id long, offset long"))


def pack(items: DataFrame, capacity: int, slack: int | None = None, per_task: int = PER_TASK) -> DataFrame:
    """items: item (distinct long), size (1 to capacity). Returns per item: item,
    sequence_id (its bin's smallest item) and offset (its place in the bin)."""
    slack = capacity // 256 if slack is None else slack
    flat = F.concat(*(F.expr(f"unhex(concat_ws('', transform(reverse(sequence(0, 7)), i -> substring(lpad(hex({c}), 16, '0'), i * 2 + 1, 2))))") for c in ("item", "size")))
    left = items.where(F.col("size") < capacity).select(F.col("item").alias("bin"), F.col("size").cast("long").alias("size"), flat.alias("items"))
    n, closed = left.count(), []
    while n:
        tasks = -(-n // per_task)
        packed = map_arrow(left.repartition(tasks, "bin"), partial(_pack, capacity=capacity, slack=slack), BIN)
        packed = materialize(packed, "bins")
        rest = packed.where("not done").count()
        if tasks == 1 or rest > 0.9 * n:
            closed.append(packed)
            break
        closed.append(packed.where("done"))
        left, n = packed.where("not done").drop("done"), rest
    full = items.where(F.col("size") >= capacity).select("item", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    for bins in closed:
        full = full.unionByName(map_arrow(bins.select("bin", "items"), _members, "item long, sequence_id long, offset long"))
    return full


def pack_documents(documents: DataFrame, path: str | None = None, limit: int = LIMIT, with_ids: bool = False) -> DataFrame:
    """Per piece: PIECES (and ids), sequence_id and offset."""
    cut = pieces(documents, path or tokenizer_path(), limit, with_ids).withColumn("item", F.monotonically_increasing_id())
    cut = materialize(cut, "pieces")
    placed = pack(cut.select("item", F.col("length").alias("size")), limit)
    return cut.join(placed, "item").drop("item")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens, ids (little-endian
    unsigned 32-bit), from what pack_documents returns with ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts"))
    return joined.select("sequence_id", "n_tokens", F.expr("aggregate(parts, cast('' as binary), (s, x) -> concat(s, x.ids))").alias("ids"))
