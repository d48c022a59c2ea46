"""Operator 6, toxicity by class-conditional Kneser-Ney models.

A word's count in a class is its continuation count: before how many distinct words
it is seen there, so copies of a text add nothing. A class's model discounts these
counts by DISCOUNT and gives BACKOFF of its mass to continuation counts that both
classes share; a rare word, whose counts the discount takes up, is as likely in both.
Counts are exact, over all labelled training documents, of 64-bit hashes of words. A
document's log-likelihoods, toxic and ordinary, are normalised by length passage by
passage (PASSAGE words, or all of a shorter text); its score is the difference in
the passage where it is largest, made a probability by one rising logistic curve.
The curve is fitted on about CALIBRATE training documents of up to BLOCK bytes in FOLDS
folds, each scored by counts that leave its fold out; where these documents know over BLOCK
words of the model, on half as many, until they don't, since their words are sent to executors.

The words whose counts outlast the discount are sent to executors, up to BLOCK of
them (the commonest, 12 bytes each); the other words of a larger model meet the
words of documents in a shuffle join, so nothing is left out.

Defined results: a text without words (null too) scores as a difference of zero does.
Repeated rows each give a row; a doc_id with several labels is toxic if one says
so. Without rows of both classes every score is the share of toxic labels, or 0.
Null doc_ids have no labels. Other columns are kept by ``keep_ordinary`` as they are."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.llm.common import arrow_schema, as_binary, crc_mod, free_name, map_arrow, materialize, mixed, runs, text_bytes, word_hashes

DISCOUNT, BACKOFF, PASSAGE = 3, 0.1, 2
BLOCK = 2_000_000
BROADCAST_LABELS = 2_000_000
CALIBRATE, FOLDS = 20_000, 4
#: Bytes of text whose pairs are reduced together, and hashed together (hashing takes some 40 times its text).
COUNT_BYTES, HASH_BYTES = 3_000_000, 1_000_000
THRESHOLD = 0.7


def pairs_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, hash of it with the word before it (of itself alone at a text's start), and which text it is of."""
    word, counts = word_hashes(texts)
    before = np.roll(word, 1)
    before[(np.cumsum(counts) - counts)[counts > 0]] = 0
    return word, mixed(word * np.uint64(0x9E3779B97F4A7C15) ^ before), np.repeat(np.arange(len(texts)), counts)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct pairs of some texts, with the bits of all classes and folds that hold them."""
    schema = arrow_schema("word long, pair long, seen int")
    words, pairs, marks, held = [], [], [], 0

    def reduced() -> pa.RecordBatch:
        pair, first, back = np.unique(np.concatenate(pairs), return_index=True, return_inverse=True)
        seen = np.zeros(len(pair), np.int32)
        np.bitwise_or.at(seen, back, np.concatenate(marks))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(words)[first].view(np.int64)), pa.array(pair.view(np.int64)), pa.array(seen)], schema=schema)

    for batch in batches:
        texts, bits = text_bytes(batch.column(0)), batch.column(1).to_numpy().astype(np.int32)
        sizes = [len(x) for x in texts]
        for a, b in runs(sizes, HASH_BYTES):
            word, pair, of = pairs_of(texts[a:b])
            words.append(word)
            pairs.append(pair)
            marks.append(bits[a:b][of])
            held += sum(sizes[a:b])
            if held >= COUNT_BYTES:
                yield reduced()
                words, pairs, marks, held = [], [], [], 0
    if pairs:
        yield reduced()


def mask(label: int, without: int | None = None) -> int:
    """Bits of a class, in all folds but one; the last bits are of the rows in no fold."""
    return sum(1 << 2 * f + label for f in range(FOLDS + 1) if f != without)


def count_name(label: int, without: int | None = None) -> str:
    return f"n{label}" + ("" if without is None else f"_{without}")


COUNTS = [(label, without) for without in (None, *range(FOLDS)) for label in (0, 1)]


def count(labelled: DataFrame) -> DataFrame:
    """labelled: text (binary), toxic (0 or 1), fold. Per word: word, n (words before it, of both classes),
    n0 and n1 (of each class), and n0_f, n1_f (without fold f)."""
    bits = F.expr("shiftleft(1, cast(2 * fold + toxic as int))")
    raw = map_arrow(labelled.select("text", bits.alias("seen")), _pairs, "word long, pair long, seen int")
    pairs = raw.groupBy("word", "pair").agg(F.bit_or("seen").alias("seen"))
    each = [F.count_if(F.col("seen").bitwiseAND(mask(*x)) != 0).alias(count_name(*x)) for x in COUNTS]
    return materialize(pairs.groupBy("word").agg(F.count("*").alias("n"), *each), "word-counts")


def ratios(counts: DataFrame) -> DataFrame:
    """word, n, and the log of toxic over ordinary likelihood by all counts (ratio) and without each fold (ratio_f)."""
    left = lambda x: F.greatest(F.col(count_name(*x)) - DISCOUNT, F.lit(0))
    totals = counts.agg(F.sum("n").alias("all"), F.count("*").alias("types"), *(F.sum(left(x)).alias(f"sum_{count_name(*x)}") for x in COUNTS)).head()
    shared = (F.col("n") + 0.5) / F.lit(float((totals["all"] or 0) + 0.5 * totals["types"]))

    def likelihood(label: int, without: int | None) -> Column:
        return (1 - BACKOFF) * left((label, without)) / F.lit(float(max(totals[f"sum_{count_name(label, without)}"] or 0, 1))) + BACKOFF * shared

    one = lambda f: F.log(likelihood(1, f) / likelihood(0, f)).cast("float").alias("ratio" if f is None else f"ratio_{f}")
    known = counts.where(F.greatest("n0", "n1") > DISCOUNT)  # without a fold there is no more left
    return known.select("word", "n", *map(one, (None, *range(FOLDS))))


class Fitted(NamedTuple):
    """share: of toxic labels. words: hashes, sorted, and the ratio of each. rest: the ratios of a larger
    model's other words. curve: slope and height; without it every score is the share."""

    share: float
    words: Broadcast | None = None
    rest: DataFrame | None = None
    curve: tuple[float, float] | None = None


def look_up(known: tuple[np.ndarray, np.ndarray], word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ratio of each word, 0 for unknown ones, and which words are known."""
    keys, values = known
    if not len(keys):
        return np.zeros(len(word), np.float32), np.zeros(len(word), bool)
    at = np.minimum(np.searchsorted(keys, word), len(keys) - 1)
    found = keys[at] == word
    return np.where(found, values[at], np.float32(0)), found


def largest(ratio: np.ndarray, counts: np.ndarray, passage: int = PASSAGE) -> np.ndarray:
    """Per text the largest mean ratio of its passages of ``passage`` words (or all words of a shorter text), 0 without words."""
    ends = np.cumsum(counts)
    sums = np.append(0.0, np.cumsum(ratio, dtype=np.float64))
    out = np.zeros(len(counts))
    short = (counts > 0) & (counts < passage)
    out[short] = (sums[ends] - sums[ends - counts])[short] / counts[short]
    long = np.flatnonzero(counts >= passage)
    if len(long):
        n = counts[long] - passage + 1
        first = np.cumsum(n) - n
        start = np.repeat((ends - counts)[long] - first, n) + np.arange(int(n.sum()))
        out[long] = np.maximum.reduceat(sums[start + passage] - sums[start], first) / passage
    return out


def differences(texts: list[bytes], known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    out = np.zeros(len(texts))
    for a, b in runs([len(x) for x in texts], HASH_BYTES):
        word, counts = word_hashes(texts[a:b])
        out[a:b] = largest(look_up(known, word)[0], counts)
    return out


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (never falling) and height."""
    middle, spread, w = x.mean(), x.std() + 1e-9, np.zeros(2)
    z = np.column_stack([(x - middle) / spread, np.ones(len(x))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w += np.clip(np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + 0.1 * np.eye(2), z.T @ (y - p) - 0.1 * w), -4, 4)
    slope = max(0.0, w[0] / spread)
    return float(slope), float(w[1] - slope * middle)


def curved(x: np.ndarray, fitted: Fitted) -> np.ndarray:
    if fitted.curve is None:
        return np.full(len(x), float(fitted.share))
    return 1 / (1 + np.exp(-np.clip(x * fitted.curve[0] + fitted.curve[1], -30, 30)))


def _by_fold(batches: Iterator[pa.RecordBatch], known: Broadcast) -> Iterator[pa.RecordBatch]:
    keys, *by_fold = known.value
    for batch in batches:
        texts, fold, out = text_bytes(batch.column(0)), batch.column(1).to_numpy(), np.zeros(batch.num_rows)
        for f in np.unique(fold).tolist():
            at = np.flatnonzero(fold == f)
            out[at] = differences([texts[i] for i in at], (keys, by_fold[f]))
        yield pa.RecordBatch.from_arrays([pa.array(out), batch.column(2)], schema=arrow_schema("x double, toxic int"))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = text_bytes(batch.column(0))
        for a, b in runs([len(x) for x in texts], HASH_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(word_hashes(texts[a:b])[0]).view(np.int64))], names=["word"])


def _calibrating(labelled: DataFrame, model: DataFrame, most: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Rows in a fold to fit the curve on, and what the model knows of their words: at most ``most`` rows of it."""
    inside = labelled.where((F.col("fold") < FOLDS) & (F.octet_length("text") <= most)).select("text", "fold", "toxic")
    chance, share = F.pmod(F.xxhash64(F.lit(1), "text"), F.lit(1 << 30)), 1 << 30
    while True:
        sample = inside.where(chance < share)
        asked = map_arrow(sample.select("text"), _words, "word long").distinct()
        known = materialize(model.join(asked, "word", "left_semi"), "asked-ratios")
        if known.count() <= most:
            return sample, known
        share //= 2


def _sorted(table: DataFrame) -> tuple[np.ndarray, ...]:
    """Columns of a bounded table, the first as sorted unsigned numbers."""
    first, *others = (c.to_numpy() for c in table.toArrow().columns)
    order = np.argsort(first.view(np.uint64))
    return first.view(np.uint64)[order], *(x[order] for x in others)


def fit(documents: DataFrame, labels: DataFrame, block: int = BLOCK) -> Fitted:
    spark = documents.sparkSession
    known = labels.where("toxic is not null and doc_id is not null").where(crc_mod("doc_id", 3) != 1).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n, toxic = known.agg(F.count("*"), F.sum("toxic")).head()
    share = toxic / n if n else 0.0
    if not n or not toxic or toxic == n:
        return Fitted(share)
    each = max(1, min(1_000_000 // FOLDS, 1_000_000 * CALIBRATE // FOLDS // n))
    fold = F.least(F.lit(FOLDS), F.floor(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) / each)).cast("int").alias("fold")
    labelled = documents.select("doc_id", as_binary()).join(F.broadcast(known) if n <= BROADCAST_LABELS else known, "doc_id").select("text", "toxic", fold)
    model = materialize(ratios(count(labelled)), "word-ratios")
    size = model.count()
    kept = model if size <= block else model.orderBy(F.desc("n"), "word").limit(block)
    sample, asked = _calibrating(labelled, model.drop("n", "ratio"))
    sent = spark.sparkContext.broadcast(_sorted(asked))
    found = map_arrow(sample, partial(_by_fold, known=sent), "x double, toxic int").toArrow()
    sent.destroy()
    if not found.num_rows:
        return Fitted(share)
    curve = logistic(found.column(0).to_numpy(), found.column(1).to_numpy())
    rest = None
    if size > block:
        least = kept.agg(F.min(F.struct("n", (-F.col("word")).alias("w"))).alias("x")).head().x
        rest = model.where((F.col("n") < least.n) | ((F.col("n") == least.n) & (F.col("word") > -least.w))).select("word", "ratio")
    return Fitted(share, spark.sparkContext.broadcast(_sorted(kept.select("word", "ratio"))), rest, curve)


def _scored(batches: Iterator[pa.RecordBatch], fitted: Fitted, name: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = text_bytes(batch.column(batch.schema.get_field_index("text")).cast(pa.binary()))
        x = np.zeros(len(texts)) if fitted.curve is None else differences(texts, fitted.words.value)
        yield batch.append_column(name, pa.array(curved(x, fitted)))


def _spread(batches: Iterator[pa.RecordBatch], fitted: Fitted) -> Iterator[pa.RecordBatch]:
    """Per document its known ratios, and the places and words that the sent part of the model lacks."""
    for batch in batches:
        texts, rows = text_bytes(batch.column(1)), batch.column(0)
        for a, b in runs([len(x) for x in texts], HASH_BYTES):
            word, counts = word_hashes(texts[a:b])
            ratio, found = look_up(fitted.words.value, word)
            for i, end, n in zip(range(a, b), np.cumsum(counts).tolist(), counts.tolist(), strict=True):
                odd = np.flatnonzero(~found[end - n : end])
                yield pa.RecordBatch.from_arrays(
                    [rows.slice(i, 1), pa.array([ratio[end - n : end].tobytes()], pa.binary()), pa.array([odd.astype(np.int64)], pa.list_(pa.int64())), pa.array([word[end - n : end][odd].view(np.int64)], pa.list_(pa.int64()))],
                    names=["row", "ratios", "places", "words"],
                )


def _gathered(batches: Iterator[pa.RecordBatch], fitted: Fitted) -> Iterator[pa.RecordBatch]:
    """Rows of a document follow one another, its known ratios first."""
    schema, now, ratio = arrow_schema("row long, score double"), None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array(curved(largest(ratio, np.array([len(ratio)])), fitted))], schema=schema)

    for batch in batches:
        for row, place, ratios_, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if place < 0:
                if ratio is not None:
                    yield done()
                now, ratio = row, np.frombuffer(ratios_, np.float32).copy()
            else:
                ratio[place] = value
    if ratio is not None:
        yield done()


def with_score(documents: DataFrame, fitted: Fitted, name: str) -> DataFrame:
    """documents with a column of scores."""
    schema = T.StructType([*documents.schema.fields, T.StructField(name, T.DoubleType())])
    if fitted.rest is None:
        return map_arrow(documents, partial(_scored, fitted=fitted, name=name), schema)
    number = free_name(documents.columns, "row")
    marked = materialize(documents.withColumn(number, F.monotonically_increasing_id()), "numbered")
    sent = fitted._replace(rest=None)
    found = materialize(map_arrow(marked.select(number, as_binary()), partial(_spread, fitted=sent), "row long, ratios binary, places array<long>, words array<long>"), "known-ratios")
    odd = found.select("row", F.explode(F.arrays_zip("places", "words")).alias("x")).select("row", F.col("x.places").alias("place"), F.col("x.words").alias("word"))
    late = odd.join(fitted.rest, "word").select("row", "place", F.lit(None).cast("binary").alias("ratios"), "ratio")
    first = found.select("row", F.lit(-1).cast("long").alias("place"), "ratios", F.lit(0).cast("float").alias("ratio"))
    ordered = first.unionByName(late).repartition("row").sortWithinPartitions("row", "place")
    scored = map_arrow(ordered, partial(_gathered, fitted=sent), "row long, score double").select(F.col("row").alias(number), F.col("score").alias(name))
    return marked.join(scored, number).select(*documents.columns, name)


def score(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    fitted = fit(documents, labels, block)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), as_binary(), (crc_mod("doc_id", 3) == 1).alias("held_out"))
    return with_score(rows, fitted, "score").select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_ordinary(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents that aren't predicted toxic, with all their columns."""
    name = free_name(documents.columns, "score")
    return with_score(documents, fit(documents, labels), name).where(F.col(name) < threshold).drop(name)
