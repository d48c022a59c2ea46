"""Operator 5, SimHash near-duplicates through vantage-point trees.

Fingerprints are computed where documents are read and reduced to distinct ones.
Two fingerprints within 3 bits agree up to 1 bit in one of their halves. So there
is a tree for each half: its nodes hold a vantage point (a half) and a radius,
fitted on a bounded sample, and send a fingerprint to the inside or the outside by
its Hamming distance; one within 1 bit of the boundary visits both (the triangle
bound prunes the other side else). Each leaf is a shard. In a shard fingerprints are
grouped by their half, a group meets the groups whose halves differ in a bit, and
the other halves decide; what is linked already isn't compared again, so a shard of
any size takes about linear time. A shard gives a spanning forest, so no link between
different fingerprints is lost and no group's pairs are listed. Components come from
star contractions.

``keep_one`` takes away near-duplicates by five-word shingles and a Jaccard
similarity of at least 0.8. Sixteen 32-bit SimHash fingerprints of a text are each
made of its DRAWN shingles with the smallest hashes in an order of their own, so that
two texts have one in common if they draw the same shingles, as often as their
similarity says, wherever they differ. Each fingerprint has its trees. Of texts with
the same one, all meet the TYPICAL ones (that share their other fingerprints with
most, as an original does with its copies) and their neighbours in the order of the
other fingerprints; typical texts meet those that are 1 bit away. So a group of any
size gives a few candidates a text, and exact sets of shingles decide on each.

What these candidates leave apart is then searched exactly, so no link is lost. In any
order of all shingles, two similar texts have one in common among the first few of
each (those that the similarity lets it lack, and one more). The order puts shingles
last that are frequent in a sample; what it is decides only on the work. Of texts with
such a shingle in common, pairs that aren't linked yet are possible if their sizes and
the parities of their shingles (a bound on how many they don't share) allow it.
Texts with a possible pair, at any remove, are a cluster. They meet again by the
order of their own shingles, and exact sets decide; a large cluster is cut in blocks,
each pair of blocks a task of bounded size. Tasks give spanning forests.

Defined results: a text without words (null too) has fingerprint zero, linked
like any other. Repeated rows each give a row. component_id ignores null doc_ids
unless there is nothing else. An empty table gives no rows. keep_one keeps all columns,
whatever their names."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import arrow_schema, as_binary, free_name, map_arrow, materialize, mixed, runs, text_bytes, word_hashes

RADIUS, HALF = 3, 1
SAMPLE, LEAF = 20_000, 4096
WIDTH, SIMILARITY, PRINTS, DRAWN = 5, 0.8, 16, 3
#: Documents of which shingles are counted, and the commonest shingles that come last in the order.
COUNTED, COMMON = 5_000, 200_000
#: First shingles in a shard; shingles and texts in a block of a cluster.
FIRST, BLOCK, BLOCK_TEXTS = 250_000, 1 << 18, 1024
#: Rows' keys (16 bytes each) that are sent to all executors; beyond it the join is a shuffle, with the same rows.
FEW = 500_000


def fingerprint(text: bytes) -> int:
    words = text.lower().split()  # on bytes: ASCII case and ASCII white space only
    if not words:
        return 0
    if len(words) < 3:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        digest, line = xxhash.xxh64_intdigest, b" ".join(words)
        ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
        starts = [0, *(e + 1 for e in ends[:-3])]
        hashes = [digest(line[a:b], 42) for a, b in zip(starts, ends[2:], strict=True)]
    count = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        part = np.array(hashes[i : i + 8192], "<u8")
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * count > len(hashes)).tolist())


def _fingerprints(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.array([fingerprint(x) for x in text_bytes(batch.column(1))], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values), *batch.columns[2:]], schema=schema)


def fingerprints(documents: DataFrame, *more: str) -> DataFrame:
    """doc_id, fp, and the columns ``more`` (long)."""
    spec = ", ".join(f"{c} long" for c in ("doc_id", "fp", *more))
    return map_arrow(documents.select(F.col("doc_id").cast("long").alias("doc_id"), as_binary(), *more), partial(_fingerprints, schema=arrow_schema(spec)), spec)


def split(values: np.ndarray, seed: int) -> tuple[int, int] | None:
    """A vantage point and a radius that part these values, of some tries the best balanced."""
    rng = np.random.default_rng(seed)
    best = None
    for v in rng.choice(values, min(8, len(values)), replace=False):
        d = np.bitwise_count(values ^ v).astype(np.int64)
        r = int(np.median(d))
        for radius in (r, r - 1):
            both = max(np.count_nonzero(d <= radius + 1), np.count_nonzero(d > radius - 1))
            if radius >= 0 and (best is None or both < best[0]):
                best = (both, int(v), radius)
    return best[1:] if best and best[0] < 0.9 * len(values) else None


def grow(values: np.ndarray, scale: float, leaf: int, seed: int = 0) -> list | int:
    """A tree of [vantage point, radius, inside, outside]; leaves are None, numbered later."""
    if len(values) * scale <= leaf or len(values) < 16 or (found := split(values, seed)) is None:
        return None
    v, r = found
    d = np.bitwise_count(values ^ values.dtype.type(v))
    return [v, r, grow(values[d <= r], scale, leaf, seed * 2 + 1), grow(values[d > r], scale, leaf, seed * 2 + 2)]


def routes(tree: list | None, values: np.ndarray, margin: int) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf number, which values visit it): those whose ball meets the leaf."""
    stack, number = [(tree, np.arange(len(values)))], 0
    while stack:
        node, which = stack.pop()
        if node is None:
            yield number, which
            number += 1
            continue
        v, r, inside, outside = node
        d = np.bitwise_count(values[which] ^ values.dtype.type(v)).astype(np.int64)
        stack += [(outside, which[d > r - margin]), (inside, which[d <= r + margin])]


class Forest:
    """Union-find over the places 0 to n - 1; every place points to its root, the smallest place of its component."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.root[a], self.root[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up


def flips(bits: int) -> np.ndarray:
    """All 32-bit words with this many bits set."""
    out = np.zeros(1, np.uint32)
    for _ in range(bits):
        out = np.unique(out[:, None] | (np.uint32(1) << np.arange(32, dtype=np.uint32))[None])
        out = out[np.bitwise_count(out) == out.max().bit_count()] if len(out) else out
    return out[np.bitwise_count(out) == bits]


def find(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``asked`` and in the sorted distinct ``keys`` that are equal."""
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    hit = np.flatnonzero(keys[at] == asked)
    return hit, at[hit]


def link_group(other: np.ndarray, places: np.ndarray, radius: int, forest: Forest) -> None:
    """Links among fingerprints with the same half; other: their other halves, sorted and distinct. A large
    group looks up what differs in 1, 2 and more bits, without those that are in its largest component by then."""
    n = len(other)
    if n <= 2048:
        for a in range(0, n, 512):
            x, y = np.nonzero(np.bitwise_count(other[a : a + 512, None] ^ other[None, a:]) <= radius)
            forest.join(places[a + x], places[a + y])
        return
    asked = np.arange(n)
    for bits in range(1, radius + 1):
        for flip in flips(bits):
            hit, at = find(other, other[asked] ^ flip)
            forest.join(places[asked[hit]], places[at])
        roots, sizes = np.unique(forest.root[places], return_counts=True)
        asked = np.flatnonzero(forest.root[places] != roots[sizes.argmax()])


def link(values: np.ndarray, half: int, forest: Forest) -> None:
    """All links among distinct fingerprints of which one half (0 the low one) differs in at most 1 bit."""
    key, other = _halves(values, half), _halves(values, 1 - half)
    order = np.lexsort((other, key))
    key, other = key[order], other[order]
    keys, first = np.unique(key, return_index=True)
    upto = np.append(first[1:], len(key))
    for a, b in zip(first[upto - first > 1].tolist(), upto[upto - first > 1].tolist(), strict=True):
        link_group(other[a:b], order[a:b], RADIUS, forest)
    for flip in flips(1):
        left, right = find(keys, keys ^ flip)
        left, right = left[left < right], right[left < right]
        pairs = (upto - first)[left] * (upto - first)[right]
        for i in np.flatnonzero(pairs > 1 << 16).tolist():  # large groups: look up what differs in up to 2 bits more
            x, y = np.arange(first[left[i]], upto[left[i]]), np.arange(first[right[i]], upto[right[i]])
            for bits in range(RADIUS):
                for more in flips(bits):
                    hit, at = find(other[y], other[x] ^ more)
                    forest.join(order[x[hit]], order[y[at]])
        small = np.flatnonzero(pairs <= 1 << 16)
        for a, b in runs(pairs[small].tolist(), 1 << 18):
            l, r, n = left[small[a:b]], right[small[a:b]], pairs[small[a:b]]
            within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            wide = np.repeat((upto - first)[r], n)
            x, y = np.repeat(first[l], n) + within // wide, np.repeat(first[r], n) + within % wide
            near = np.bitwise_count(other[x] ^ other[y]) < RADIUS
            forest.join(order[x[near]], order[y[near]])


def _halves(values: np.ndarray, which: int) -> np.ndarray:
    return (values >> np.uint64(32 * which)).astype(np.uint32)


def _route(batches: Iterator[pa.RecordBatch], trees: list) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema("shard long, fps binary")
    for batch in batches:
        values = batch.column(0).to_numpy().view(np.uint64)
        for half, tree in enumerate(trees):
            found = [(2 * leaf + half, values[which].tobytes()) for leaf, which in routes(tree, _halves(values, half), HALF) if len(which)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.binary())], schema=schema)


def _link_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a shard follow one another."""
    schema = arrow_schema("a long, b long")

    def done(shard: int, parts: list[bytes]) -> pa.RecordBatch:
        values = np.unique(np.frombuffer(b"".join(parts), np.uint64))
        forest = Forest(len(values))
        link(values, shard % 2, forest)
        joined = np.flatnonzero(forest.root != np.arange(len(values)))
        return pa.RecordBatch.from_arrays([pa.array(values[x].view(np.int64)) for x in (joined, forest.root[joined])], schema=schema)

    now, parts = None, []
    for batch in batches:
        for shard, fps in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if shard != now and parts:
                yield done(now, parts)
                parts = []
            now = shard
            parts.append(fps)
    if parts:
        yield done(now, parts)


def _sampled(distinct: DataFrame, key: str, n: int, most: int = SAMPLE) -> DataFrame:
    """About ``most`` rows, only to fit trees and an order."""
    return distinct.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < min(1_000_000, 1_000_000 * most // max(n, 1) + 1))


def links(distinct: DataFrame) -> DataFrame:
    """distinct: fp (long, distinct). Links a, b of a spanning forest of each shard."""
    n = distinct.count()
    sample = np.sort(_sampled(distinct.select("fp"), "fp", n).toArrow().column(0).to_numpy().astype(np.int64)).view(np.uint64)
    trees = [grow(_halves(sample, h), n / max(len(sample), 1), LEAF) for h in (0, 1)]
    shards = map_arrow(distinct.select("fp"), partial(_route, trees=trees), "shard long, fps binary")
    return map_arrow(shards.repartition("shard").sortWithinPartitions("shard"), _link_shards, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (its component's smallest node), by large and small stars in turn."""
    edges = materialize(edges, "links")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        new = materialize(small, "links")
        if not new.exceptAll(edges).head(1) and new.count() == edges.count():
            return new.select(F.col("a").alias("node"), F.col("b").alias("root"))
        edges = new


def rooted(classes: DataFrame) -> DataFrame:
    """classes(fp, distinct, and more) with root, the smallest fingerprint of the component."""
    nodes = components(links(classes.select("fp")))
    return classes.join(nodes, classes["fp"] == nodes["node"], "left").select(*classes.columns, F.coalesce("root", "fp").alias("root"))


def groups(documents: DataFrame) -> DataFrame:
    """Per document row: doc_id, fp, component_id."""
    prints = materialize(fingerprints(documents), "fingerprints")
    classes = rooted(materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes"))
    tops = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(classes.join(tops, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def report(documents: DataFrame) -> DataFrame:
    return groups(documents).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: ASCII white space parts words, A-Z count as a-z; the byte 0 is a letter like any other.
TEXT_BYTES = np.arange(256, dtype=np.uint8)
TEXT_BYTES[65:91] += 32
TEXT_BYTES[[9, 10, 11, 12, 13, 32]] = 0
TEXT_BYTES[0] = 9
def shingles(word: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text's shingles, sorted, all of its words where there are fewer; and how many each text has."""
    n = np.where(counts > 0, np.maximum(counts - width + 1, 1), 0)
    of = np.repeat(np.arange(len(counts)), n)
    at = np.arange(int(n.sum())) + np.repeat(np.cumsum(counts) - counts - np.cumsum(n) + n, n)
    size, out = np.minimum(counts, width)[of], np.zeros(len(of), np.uint64)
    for k in range(width):
        more = mixed(out * np.uint64(0xC2B2AE3D27D4EB4F) + word[np.minimum(at + k, len(word) - 1)]) if len(word) else out
        out = np.where(k < size, more, out)
    order = np.lexsort((out, of))
    out, of = out[order], of[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (of[1:] != of[:-1])
    return out[new], np.bincount(of[new], minlength=len(counts))


def prints(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """PRINTS 32-bit fingerprints of each text, from the distinct hashes of its shingles."""
    out, some = np.zeros((len(counts), PRINTS), np.uint32), np.flatnonzero(counts)
    if not len(some):
        return out
    n = counts[some]
    start, of, most = np.cumsum(n) - n, np.repeat(np.arange(len(some)), n), np.uint64((1 << 64) - 1)
    real = np.minimum(n, DRAWN)[:, None]
    for i in range(PRINTS):
        order = mixed(hashes + np.uint64((i + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        drawn = np.zeros((len(some), DRAWN), np.uint64)
        for k in range(DRAWN):
            drawn[:, k] = np.minimum.reduceat(order, start)
            order[order == drawn[of, k]] = most
        bits = np.unpackbits(mixed(drawn).view(np.uint8).reshape(len(some), DRAWN, 8)[:, :, :4], axis=2, bitorder="little")
        ones = 2 * (bits * (np.arange(DRAWN) < real)[:, :, None]).sum(axis=1) > real
        out[some, i] = np.packbits(ones, axis=1, bitorder="little").view(np.uint32).ravel()
    return out


def text_keys(word: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A hash of each text's words in order."""
    sums = np.append(np.uint64(0), np.cumsum(mixed(word + np.uint64(0x9E3779B97F4A7C15) * (np.arange(len(word)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.uint64))))
    ends = np.cumsum(counts)
    return mixed(sums[ends] - sums[ends - counts] + counts.astype(np.uint64)).view(np.int64)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, a, b to doc_id, a, b, the text's key, its fingerprints and how many shingles it has."""
    for batch in batches:
        texts = text_bytes(batch.column(1))
        for i, j in runs([len(x) for x in texts], 1_000_000):
            word, counts = word_hashes(texts[i:j], TEXT_BYTES)
            hashes, n = shingles(word, counts, WIDTH)
            rows = [x.tobytes() for x in prints(hashes, n)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in (0, 2, 3)), pa.array(text_keys(word, counts)), pa.array(rows, pa.binary()), pa.array(n.astype(np.int64))], schema=arrow_schema(SKETCH))


SETS = "key long, members binary, odd binary, n long"
SKETCH = "doc_id long, a long, b long, key long, prints binary, n long"
#: A text in a shard: the fingerprint that it is there by, the others from this one on in turn, its key.
MEMBER = np.dtype([("value", "<u4"), ("others", "<u4", (PRINTS - 1,)), ("key", "<i8")])
#: Of each fingerprint's texts, those that all others meet.
TYPICAL = 4


def _route_pieces(batches: Iterator[pa.RecordBatch], trees: list) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema("shard long, members binary")
    for batch in batches:
        rows = np.zeros(batch.num_rows, MEMBER)
        rows["key"] = batch.column(0).to_numpy()
        found_prints = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").reshape(-1, PRINTS)
        for piece, tree in enumerate(trees):
            rows["value"] = found_prints[:, piece]
            rows["others"] = found_prints[:, [(piece + 1 + j) % PRINTS for j in range(PRINTS - 1)]]
            found = [(PRINTS * leaf + piece, rows[which].tobytes()) for leaf, which in routes(tree, found_prints[:, piece], HALF) if len(which)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.binary())], schema=schema)


def candidates(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of candidate pairs among a shard's texts (of MEMBER): a few a text."""
    rows = rows[np.lexsort((rows["key"], *rows["others"][:, :3].T[::-1], rows["value"]))]
    value, key = rows["value"], rows["key"]
    alike = np.zeros(len(rows), np.int64)  # over the other fingerprints, how many share it and the value
    for j in range(PRINTS - 1):
        _, of, n = np.unique(value.astype(np.uint64) << np.uint64(32) | rows["others"][:, j], return_inverse=True, return_counts=True)
        alike += n[of]
    order = np.lexsort((key, -alike, value))
    ranked = key[order]
    values, first, back, n = np.unique(value[order], return_index=True, return_inverse=True, return_counts=True)
    pairs = []
    for t in range(TYPICAL):
        more = np.flatnonzero(n[back] > t)
        pairs.append((ranked[first[back[more]] + t], ranked[more]))
    same = np.flatnonzero(value[1:] == value[:-1])
    pairs.append((key[same], key[same + 1]))
    for flip in flips(1):
        x, y = find(values, values ^ flip)
        pairs.append((ranked[first[x]], ranked[first[y]]))
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    return np.maximum(a, b)[a != b], np.minimum(a, b)[a != b]


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a shard follow one another."""
    schema = arrow_schema("a long, b long")

    def done(parts: list[bytes]) -> pa.RecordBatch:
        a, b = candidates(np.frombuffer(b"".join(parts), MEMBER))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

    now, parts = None, []
    for batch in batches:
        for shard, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if shard != now and parts:
                yield done(parts)
                parts = []
            now = shard
            parts.append(members)
    if parts:
        yield done(parts)


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, text to key, shingles, their parities and how many there are."""
    for batch in batches:
        texts = text_bytes(batch.column(1))
        for i, j in runs([len(x) for x in texts], 1_000_000):
            found, counts = shingles(*word_hashes(texts[i:j], TEXT_BYTES), WIDTH)
            sets = np.split(found, np.cumsum(counts)[:-1])
            columns = [pa.array([f(x) for x in sets], pa.binary()) for f in (np.ndarray.tobytes, parities)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *columns, pa.array(counts.astype(np.int64))], schema=arrow_schema(SETS))


def _similar(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Pairs of rows a, b, set, set whose Jaccard similarity is enough."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= least * max(len(x), len(y)) else 0
            keep.append(both >= least * (len(x) + len(y) - both) if len(x) or len(y) else True)
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], schema=arrow_schema("a long, b long"))


def similar_pairs(texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """texts: key (long, distinct), prints, a, b (naming a row of the table ``source`` that has the text).
    Candidates of all shards, a > b, not yet verified."""
    n = texts.count()
    found = _sampled(texts.select("key", "prints"), "key", n).select("prints").toArrow().column(0)
    sample = np.frombuffer(b"".join(found.to_pylist()), "<u4").reshape(-1, PRINTS)
    trees = [grow(sample[:, i].copy(), n / max(len(sample), 1), LEAF) for i in range(PRINTS)]
    shards = map_arrow(texts.select("key", "prints"), partial(_route_pieces, trees=trees), "shard long, members binary")
    return map_arrow(shards.repartition("shard").sortWithinPartitions("shard"), _candidates, "a long, b long").distinct()


def needed(size: np.ndarray, least: float) -> np.ndarray:
    """How many shingles of a text of this size each similar text has at least; never too many by rounding."""
    return np.ceil(least * size - 1e-6).astype(np.int64)


def first_ones(of: np.ndarray, counts: np.ndarray, least: float) -> np.ndarray:
    """Which shingles are among the first of their texts that are looked up; of: their texts, ascending, in order within each."""
    return np.arange(len(of)) - (np.cumsum(counts) - counts)[of] <= (counts - needed(counts, least))[of]


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = text_bytes(batch.column(0))
        for i, j in runs([len(x) for x in texts], 1_000_000):
            yield pa.RecordBatch.from_arrays([pa.array(shingles(*word_hashes(texts[i:j], TEXT_BYTES), WIDTH)[0].view(np.int64))], schema=arrow_schema("shingle long"))


def common_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """texts: text (binary), a sample. Shingles of two texts and more, sorted, at most the COMMON commonest, and their counts."""
    counts = map_arrow(texts.select("text"), _shingle_rows, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    found = counts.orderBy(F.desc("n"), "shingle").limit(COMMON).toArrow()
    hashes, n = found.column(0).to_numpy().view(np.uint64), found.column(1).to_numpy()
    order = np.argsort(hashes)
    return hashes[order], n[order]


#: A first shingle of a text, in a shard.
ENTRY = np.dtype([("shingle", "<u8"), ("key", "<i8")])


def _first_shingles(batches: Iterator[pa.RecordBatch], common: tuple[np.ndarray, np.ndarray], least: float, shards: int) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema("shard long, entries binary")
    for batch in batches:
        texts, parts = text_bytes(batch.column(0)), []
        for i, j in runs([len(x) for x in texts], 1_000_000):
            word, counts = word_hashes(texts[i:j], TEXT_BYTES)
            key, (hashes, n) = text_keys(word, counts), shingles(word, counts, WIDTH)
            of, times = np.repeat(np.arange(len(n)), n), np.zeros(len(hashes), np.int64)
            if len(common[0]):
                hit, at = find(common[0], hashes)
                times[hit] = common[1][at]
            order = np.lexsort((hashes, times, of))
            order = order[first_ones(of, n, least)]
            rows = np.zeros(len(order), ENTRY)
            rows["shingle"], rows["key"] = hashes[order], key[of[order]]
            parts.append(rows)
        rows = np.unique(np.concatenate(parts)) if parts else np.zeros(0, ENTRY)  # copies in a batch count once
        shard = (rows["shingle"] % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        rows, (found, first) = rows[order], np.unique(shard[order], return_index=True)
        pieces = [x.tobytes() for x in np.split(rows, first[1:])] if len(found) else []
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(pieces, pa.binary())], schema=schema)


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a shard follow one another. First shingles of two texts and more."""
    schema = arrow_schema("shingle long, key long")

    def done(parts: list[bytes]) -> pa.RecordBatch:
        rows = np.unique(np.frombuffer(b"".join(parts), ENTRY))
        _, back, n = np.unique(rows["shingle"], return_inverse=True, return_counts=True)
        rows = rows[n[back] > 1]
        return pa.RecordBatch.from_arrays([pa.array(rows["shingle"].copy().view(np.int64)), pa.array(rows["key"].copy())], schema=schema)

    now, parts = None, []
    for batch in batches:
        for shard, entries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if shard != now and parts:
                yield done(parts)
                parts = []
            now = shard
            parts.append(entries)
    if parts:
        yield done(parts)


def parities(members: np.ndarray) -> bytes:
    """A bit for each residue of the hashes, set if an odd number of them has it; 64 bits or more, as many as hashes and up to twice."""
    width = max(64, 1 << (len(members) - 1).bit_length()) if len(members) else 64
    odd = np.bincount((members & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class Parities:
    """Bounds from below on how many hashes two texts don't share."""

    def __init__(self, rows: list[bytes]):
        self.width, self.place, self.of = np.fromiter(map(len, rows), np.int64, len(rows)), np.zeros(len(rows), np.int64), {}
        for w in np.unique(self.width).tolist():
            which = np.flatnonzero(self.width == w)
            self.place[which] = np.arange(len(which))
            self.of[w] = np.frombuffer(b"".join(rows[i] for i in which), "<u8").reshape(len(which), -1)

    def _at(self, x: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros((len(x), width // 8), np.uint64)
        for w in (width, 2 * width):
            which = np.flatnonzero(self.width[x] == w)
            if len(which):
                found = self.of[w][self.place[x[which]]]
                out[which] = found if w == width else found[:, : width // 8] ^ found[:, width // 8 :]
        return out

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        wide, narrow, out = np.maximum(self.width[x], self.width[y]), np.minimum(self.width[x], self.width[y]), np.zeros(len(x), np.int64)
        for w in np.unique(narrow).tolist():
            which = np.flatnonzero((narrow == w) & (wide <= 2 * w))  # of more different sizes nothing is said
            for i in range(0, len(which), max(1, (1 << 22) // w)):
                part = which[i : i + max(1, (1 << 22) // w)]
                out[part] = np.bitwise_count(self._at(x[part], w) ^ self._at(y[part], w)).sum(axis=1, dtype=np.int64)
        return out


def possible(shingle: np.ndarray, key: np.ndarray, root: np.ndarray, size: np.ndarray, odd: list[bytes], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a spanning forest of the pairs of texts with a shingle in common that have other roots and may be similar."""
    order = np.lexsort((size, shingle))
    shingle, key, root, size = shingle[order], key[order], root[order], size[order]
    keys, first, place = np.unique(key, return_index=True, return_inverse=True)
    known, forest = Parities([odd[order[i]] for i in first]), Forest(len(keys))
    begin = np.flatnonzero(np.diff(shingle, prepend=shingle[:1] ^ 1))
    upto = np.repeat(np.append(begin[1:], len(shingle)), np.diff(np.append(begin, len(shingle))))
    several = np.repeat(np.minimum.reduceat(root, begin) != np.maximum.reduceat(root, begin), np.diff(np.append(begin, len(shingle))))
    after = np.where(several, upto - np.arange(len(shingle)) - 1, 0)
    some = np.flatnonzero(after)
    for i, j in runs(after[some].tolist(), 1 << 18):
        n = after[some[i:j]]
        x = np.repeat(some[i:j], n)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
        near = (root[x] != root[y]) & (size[x] >= needed(size[y], least)) & (forest.root[place[x]] != forest.root[place[y]])
        x, y = x[near], y[near]
        near = known.apart(place[x], place[y]) <= (1 - least) / (1 + least) * (size[x] + size[y]) + 1e-6
        forest.join(place[x[near]], place[y[near]])
    joined = np.flatnonzero(forest.root != np.arange(len(keys)))
    return keys[joined], keys[forest.root[joined]]


def _possible(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """shingle, key, root, n, odd; rows of a shingle follow one another."""
    schema, kept = arrow_schema("a long, b long"), []

    def done(table: pa.Table) -> pa.RecordBatch:
        a, b = possible(*(table.column(c).to_numpy() for c in range(4)), table.column(4).to_pylist(), least)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

    for batch in batches:
        kept.append(batch)
        if sum(x.num_rows for x in kept) >= 20_000:
            table = pa.Table.from_batches(kept)
            values = table.column(0).to_numpy()
            whole = int(np.flatnonzero(values != values[-1])[-1]) + 1 if values[0] != values[-1] else 0  # the last shingle may go on
            if whole:
                yield done(table.slice(0, whole))
                kept = table.slice(whole).combine_chunks().to_batches()
    if sum(x.num_rows for x in kept):
        yield done(pa.Table.from_batches(kept))


def link_sets(sets: list[np.ndarray], root: np.ndarray, block: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of similar sets (sorted, distinct) that link all that are similar, beyond those of the same
    root. Sets of the same block aren't compared, where there are blocks."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    by_size = np.argsort(size, kind="stable")
    size, block = size[by_size], None if block is None else block[by_size]
    flat = np.concatenate([sets[i] for i in by_size])
    of = np.repeat(np.arange(len(sets)), size)
    _, back, times = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(times), np.int64)
    rank[np.argsort(times, kind="stable")] = np.arange(len(times))
    token = rank[back]
    token = token[np.lexsort((token, of))]
    start = np.cumsum(size) - size
    low = np.searchsorted(size, needed(size, least))  # smaller ones aren't similar
    first = np.flatnonzero(first_ones(of, size, least))
    entries = np.sort(token[first] * len(sets) + of[first])
    begin = np.searchsorted(entries, token[first] * len(sets) + low[of[first]])
    end = np.searchsorted(entries, token[first] * len(sets) + of[first])
    upto = np.searchsorted(of[first], np.arange(len(sets) + 1))
    _, group = np.unique(root[by_size], return_inverse=True)
    forest, mark, pairs = Forest(len(sets)), np.zeros(len(times), bool), []
    lead = np.full(len(sets), len(sets))
    np.minimum.at(lead, group, np.arange(len(sets)))
    forest.join(np.arange(len(sets)), lead[group])
    for x in np.flatnonzero(np.add.reduceat(end - begin, upto[:-1]) if len(first) else []).tolist():
        a, n = begin[upto[x] : upto[x + 1]], (end - begin)[upto[x] : upto[x + 1]]
        at = np.arange(int(n.sum())) + np.repeat(a - np.cumsum(n) + n, n)
        others = np.unique(entries[at] % len(sets))
        others = others[forest.root[others] != forest.root[x]]
        if block is not None:
            others = others[block[others] != block[x]]
        own = token[start[x] : start[x] + size[x]]
        mark[own] = True
        for i, j in runs(size[others].tolist(), 1 << 20):
            y = others[i:j]
            n = size[y]
            at = np.arange(int(n.sum())) + np.repeat(start[y] - np.cumsum(n) + n, n)
            both = np.add.reduceat(mark[token[at]].astype(np.int64), np.cumsum(n) - n)
            near = y[both >= least * (size[x] + n - both)]
            for z in near.tolist():
                if forest.root[z] != forest.root[x]:
                    pairs.append((x, z))
                    forest.join(np.array([x]), np.array([z]))
        mark[own] = False
    a, b = by_size[np.array(pairs, np.int64).reshape(-1, 2)].T
    return a, b


def _link_clusters(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """cluster, i, j (the task's blocks), block, key, root, members; rows of a task follow one another."""
    schema = arrow_schema("a long, b long")

    def done(task: tuple, rows: list[tuple]) -> pa.RecordBatch:
        block, key, root, members = zip(*rows, strict=True)
        sets = [np.frombuffer(x, np.uint64) for x in members]
        a, b = link_sets(sets, np.array(root, np.int64), np.array(block) if task[1] != task[2] else None, least)
        key = np.array(key, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(key[a], key[b])), pa.array(np.minimum(key[a], key[b]))], schema=schema)

    now, rows = None, []
    for batch in batches:
        for *task, block, key, root, members in zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True):
            if task != now and rows:
                yield done(now, rows)
                rows = []
            now = task
            rows.append((block, key, root, members))
    if rows:
        yield done(now, rows)


def meetings(asked: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """asked: a, text of all rows; rows: their sketches. shingle, key: first shingles of two texts and more."""
    n, first = rows.agg(F.count("*"), F.sum(F.col("n") * (1 - similarity) + 1)).first()
    common = common_shingles(_sampled(asked, "a", n, COUNTED))
    shards = map_arrow(asked.select("text"), partial(_first_shingles, common=common, least=similarity, shards=int((first or 0) // FIRST) + 1), "shard long, entries binary")
    return map_arrow(shards.repartition("shard").sortWithinPartitions("shard"), _meetings, "shingle long, key long")


def missed_pairs(sets: DataFrame, met: DataFrame, roots: DataFrame, similarity: float, few: int = FEW) -> DataFrame:
    """sets: key, members, odd, n; met: shingle, key; roots: node, root of what is linked. Links a, b that are
    lacking: with those given, all similar texts are linked."""
    linked = roots.select(F.col("node").alias("key"), F.col("root").alias("linked"))
    told = sets.select("key", "n", "odd").join(linked, "key", "left").select("key", F.coalesce("linked", "key").alias("linked"), "n", "odd")
    told = met.join(told, "key").select("shingle", "key", "linked", "n", "odd")
    near = components(map_arrow(told.repartition("shingle").sortWithinPartitions("shingle"), partial(_possible, least=similarity), "a long, b long").distinct())
    nodes = near.select(F.col("node").alias("key"), F.col("root").alias("cluster"))
    nodes = nodes.unionByName(nodes.select(F.col("cluster").alias("key"), "cluster").distinct())
    nodes = nodes.join(linked, "key", "left").select("key", "cluster", F.coalesce("linked", "key").alias("linked"))
    nodes = materialize(nodes.join(sets.select("key", "n"), "key"), "clusters")
    blocks = F.ceil(F.greatest(F.sum("n") / BLOCK, F.count("*") / BLOCK_TEXTS)).cast("long")
    open_ones = nodes.groupBy("cluster").agg(F.min("linked").alias("one"), F.max("linked").alias("two"), blocks.alias("k")).where("one <> two").select("cluster", "k")
    mine = nodes.join(open_ones, "cluster").select("cluster", "key", "linked", "k", F.pmod(F.xxhash64("key"), "k").alias("block"))
    mine = mine.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("other"))
    mine = mine.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key", "linked")
    keys = nodes.join(open_ones, "cluster").select("key")
    wanted = sets.join(F.broadcast(keys) if keys.count() <= few else keys, "key", "left_semi")
    tasks = mine.join(wanted.select("key", "members"), "key").select("cluster", "i", "j", "block", "key", "linked", "members")
    return map_arrow(tasks.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j"), partial(_link_clusters, least=similarity), "a long, b long")


def keep_one(documents: DataFrame, similarity: float = SIMILARITY, few: int = FEW) -> DataFrame:
    """One row of each group of near-duplicates (of the same words, or of similar texts): the one with the smallest doc_id
    (null only if all are), of several the first by a hash of the row."""
    row = documents.columns
    one, two = free_name(row, "row_a"), free_name(row, "row_b")
    marked = documents.withColumns({one: F.xxhash64(*row), two: F.xxhash64(F.lit(1), *row)})  # 128 bits name a row's content
    asked = marked.select(F.col("doc_id").cast("long").alias("doc_id"), as_binary(), F.col(one).alias("a"), F.col(two).alias("b"))
    rows = materialize(map_arrow(asked, _sketches, SKETCH), "sketches")
    least = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "a", "b")
    texts = materialize(rows.groupBy("key").agg(F.min(least).alias("least"), F.first("prints").alias("prints")).select("key", "least", "prints"), "texts")
    pairs = materialize(similar_pairs(texts, similarity), "candidates")
    met = materialize(meetings(asked, rows, similarity), "met")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("key")).union(met.select("key")).distinct().join(texts.select("key", F.col("least.a").alias(one), F.col("least.b").alias(two)), "key")
    nodes = materialize(nodes, "nodes")
    small = lambda df: F.broadcast(df) if df.count() <= few else df
    # rows alike in all columns are one row here, of which there may be several
    held = marked.select(one, two, as_binary()).join(small(nodes), [one, two]).select("key", "text")
    sets = materialize(map_arrow(held, _shingle_sets, SETS).dropDuplicates(["key"]), "sets")
    paired = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    left, right = (sets.join(small(paired), "key", "left_semi").select(F.col("key").alias(k), F.col("members").alias(f"{k}_members")) for k in ("a", "b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "a_members", "b_members")
    roots = components(map_arrow(both, partial(_similar, least=similarity), "a long, b long"))
    missed = materialize(missed_pairs(sets, met, roots, similarity, few), "missed")
    if missed.head(1):
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(missed))
    classes = texts.join(roots, texts["key"] == roots["node"], "left").select("least", F.coalesce("root", "key").alias("root"))
    kept = materialize(classes.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.a").alias(one), F.col("least.b").alias(two)), "kept")
    times = rows.groupBy(F.col("a").alias(one), F.col("b").alias(two)).agg(F.count("*").alias("times"))
    gone = materialize(times.join(kept, [one, two], "left_anti").select(one, two), "gone")
    again = materialize(times.where("times > 1").join(kept, [one, two], "left_semi").select(one, two), "again")
    n_gone, n_again = gone.count(), again.count()
    if n_gone + n_again > few:
        return marked.dropDuplicates([one, two]).join(kept, [one, two], "left_semi").select(*row)
    left = marked.join(F.broadcast(gone), [one, two], "left_anti")
    if not n_again:
        return left.select(*row)
    repeated = left.join(F.broadcast(again), [one, two], "left_semi").dropDuplicates([one, two])
    return left.join(F.broadcast(again), [one, two], "left_anti").unionByName(repeated).select(*row)
