"""Operator 4, nearest neighbours by a block matrix join.

Queries and base become blocks of rows. Each block of queries goes to SHARES tasks, each
block of the base to one of them for each block of queries; a task holds one
block of queries and streams blocks of the base past it, multiplying int8 tiles.
|x.y - qx.qy| is bounded from the quantisation steps, so a pair whose upper bound is
under the query's k-th lower bound can't be among its nearest. Surviving pairs are
computed again in double precision, summed in order of the components, and
each task's best go to a merge. The result is exact. Nothing passes through the driver
but counts of blocks.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part; vectors of another dimension aren't neighbours. Rows with
the query's vec_id are its own. A repeated query vec_id is asked once, with the smallest
of its vectors. A query without candidates, and an empty table, give no rows. Other
columns aren't read."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.llm.common import arrow_schema, map_arrow, materialize

#: Bytes of a block of queries, which a task holds several times over, and of a block of the base, which streams by.
QUERY_BYTES, BASE_BYTES = 8 << 20, 1 << 20
SHARES, TILE = 8, 2048
HIT = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    v = F.col(column)
    good = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col("vec_id").isNotNull() & good).select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("vector"))


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values (kept as floats, whose products are exact here), steps, and sums of absolute values."""
    step = np.abs(x).max(axis=1) / 127
    return np.rint(x / step[:, None]).astype(np.float32 if x.shape[1] <= 1000 else np.float64), step, np.abs(x).sum(axis=1)


BLOCK = "dim int, ids binary, vectors binary"


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """vec_id, vector to blocks of one dimension each."""
    for batch in batches:
        ids, lists = batch.column(0).to_numpy(), batch.column(1)
        sizes = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        starts = np.cumsum(sizes) - sizes
        for d in np.unique(sizes).tolist():
            rows, each = np.flatnonzero(sizes == d), max(1, most // (8 * d + 8))
            for a in range(0, len(rows), each):
                part = rows[a : a + each]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d], pa.int32()), pa.array([ids[part].tobytes()], pa.binary()), pa.array([flat[starts[part, None] + np.arange(d)].tobytes()], pa.binary())], names=["dim", "ids", "vectors"]
                )


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows task, is_base, dim, ids, vectors; a task's rows follow one another, its queries first."""
    schema, now, block, best = arrow_schema(HIT), None, None, {}

    def done() -> Iterator[pa.RecordBatch]:
        found = list(best.items())
        for a in range(0, len(found), 1000):
            part = found[a : a + 1000]
            q = np.repeat([x for x, _ in part], [len(i) for _, (i, _) in part])
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.concatenate([i for _, (i, _) in part])), pa.array(np.concatenate([s for _, (_, s) in part]))], schema=schema)

    for batch in batches:
        for task, is_base, dim, ids, vectors in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            names, x = np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.float64).reshape(-1, dim)
            if not is_base:
                yield from done()
                now, block, best = task, (names, x, *quantised(x)), {}
            elif task == now and dim == block[1].shape[1]:
                for a in range(0, len(names), TILE):
                    _tile(best, block, names[a : a + TILE], x[a : a + TILE], k)
    yield from done()


def _tile(best: dict, block: tuple, ids: np.ndarray, base: np.ndarray, k: int) -> None:
    base_q, base_step, base_sum = quantised(base)
    names, vectors, query_q, query_step, query_sum = block
    d = base.shape[1]
    for a in range(0, len(names), 512):
        own, steps = names[a : a + 512], query_step[a : a + 512, None] * base_step[None]
        near = (query_q[a : a + 512] @ base_q.T).astype(np.float64) * steps
        error = (query_sum[a : a + 512, None] * base_step[None] + query_step[a : a + 512, None] * base_sum[None]) / 2 + d * steps / 4
        error = error * (1 + 1e-9) + 1e-300
        near[own[:, None] == ids[None]] = -np.inf
        low = near - error
        bar = np.partition(low, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(own), -np.inf)
        known = np.array([best[q][1][-1] if q in best and len(best[q][1]) == k else -np.inf for q in own.tolist()])
        keep = (near + error >= np.maximum(bar, known)[:, None]) & (near > -np.inf)
        for i in np.flatnonzero(keep.any(axis=1)).tolist():
            which = np.flatnonzero(keep[i])
            score = np.cumsum(base[which] * vectors[a + i][None], axis=1)[:, -1]
            old = best.get(own[i].item())
            all_ids, scores = (ids[which], score) if old is None else (np.concatenate([old[0], ids[which]]), np.concatenate([old[1], score]))
            order = np.lexsort((all_ids, -scores))[:k]
            best[own[i].item()] = (all_ids[order], scores[order])


def nearest(base: DataFrame, queries: DataFrame, k: int = 20, query_bytes: int = QUERY_BYTES, base_bytes: int = BASE_BYTES, shares: int = SHARES) -> DataFrame:
    """base, queries: vec_id and vector, as usable() gives. Per query and rank:
    query_id, rank, vec_id, score (inner product), ties to the smaller vec_id."""
    asked = queries.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    number = F.monotonically_increasing_id().alias("number")
    left = materialize(map_arrow(asked, partial(_blocks, most=query_bytes), BLOCK).select(number, "*"), "query-blocks")
    right = materialize(map_arrow(base.select("vec_id", "vector"), partial(_blocks, most=base_bytes), BLOCK).select(number, "*"), "base-blocks")
    # a task is a block of queries and a share of the base; base blocks go to the tasks of their dimension
    tasks = left.select("dim", F.col("number").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
    named = F.struct("block", "share").alias("task")
    first = left.join(tasks.withColumnRenamed("dim", "d"), F.col("block") == F.col("number")).select(named, F.lit(False).alias("is_base"), "dim", "ids", "vectors")
    mine = F.pmod(F.xxhash64("number"), F.lit(shares)).cast("int")
    then = right.withColumn("share", mine).join(tasks, ["dim", "share"]).select(named, F.lit(True).alias("is_base"), "dim", "ids", "vectors")
    rows = first.unionByName(then).repartition("task").sortWithinPartitions("task", "is_base")
    numbered = rows.select(F.xxhash64("task").alias("task"), "is_base", "dim", "ids", "vectors")
    hits = map_arrow(numbered, partial(_search, k=k), HIT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def report(embeddings: DataFrame) -> DataFrame:
    rows = usable(embeddings)
    return nearest(rows, rows.where("vec_id % 20 = 0"))


ORACLE = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, b.vec_id, list_inner_product(q.e, b.e) AS score FROM g q JOIN g b ON q.vec_id % 20 = 0 AND q.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
