"""Operator 10, language identification by error-correcting output codes.

Each learned language has a codeword; each bit has a logistic classifier over
hashed letter pairs and triples. Decoding takes the codeword of the smallest loss,
bits weighted by how well their classifiers do, and flags near ties. Classifiers
are fitted on a sample of about SAMPLE training documents, spread evenly over
languages (about one each where there are more languages than that); it is the only
bounded thing here, and every language has a codeword.

Defined results: null texts and those without a letter are ``und`` with score 0, as
is everything when nothing can be learned. Repeated rows each give a row."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import arrow_schema, as_binary, crc_mod, map_arrow, runs, text_bytes

DIMS, SAMPLE = 4096, 4000
LETTER = regex.compile(r"\p{L}")
LETTERS = np.full(256, 32, np.uint8)
LETTERS[97:123] = np.arange(97, 123)
LETTERS[65:91] = np.arange(97, 123)
LETTERS[128:] = np.arange(128, 256)


def histograms(texts: list[bytes]) -> np.ndarray:
    """A row for each text: roots of n-gram counts, of length 1."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
    codes = LETTERS[np.frombuffer(b"  ".join([*texts, b""]), np.uint8)].astype(np.uint32)
    of = np.repeat(np.arange(len(texts)), sizes) * DIMS
    two = codes[:-1] << 8 | codes[1:]
    three = two[:-1] << 8 | codes[2:]
    out = np.zeros(len(texts) * DIMS)
    for grams in (two, three):
        places = (grams * np.uint32(2654435761) >> np.uint32(20)).astype(np.int64)
        real = grams & 0xFFFF != 0x2020
        out += np.bincount((of[: len(grams)] + places)[real], minlength=len(out))
    out = np.sqrt(out.reshape(len(texts), DIMS)).astype(np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def codewords(n: int) -> np.ndarray:
    """+1 and -1, a row for each class, of many random codes the one with the largest least distance."""
    bits, rng, best = 15 + 4 * max(0, int(np.ceil(np.log2(max(n, 2)))) - 2), np.random.default_rng(7), None
    for _ in range(200 if n <= 200 else 3):
        code = rng.choice([-1, 1], (n, bits))
        code[:, np.abs(code.sum(axis=0)) == n] *= np.where(np.arange(n) % 2, -1, 1)[:, None]
        apart = min((int((bits - (code[i] @ code[:i].T).max()) // 2) for i in range(1, n)), default=bits)
        if best is None or apart > best[0]:
            best = (apart, code)
    return best[1]


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = text_bytes(batch.column(0))
        for a, b in runs([len(x) + 3000 for x in texts], 1_000_000):
            rows = histograms(texts[a:b]).astype(np.float16)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary()), batch.column(1).slice(a, b - a)], schema=arrow_schema("x binary, lang string"))


def fit(documents: DataFrame) -> dict:
    known = documents.select("doc_id", "text", "lang").where("text is not null and lang is not null").where(crc_mod("doc_id", 5) != 0)
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    langs = sorted(counts)
    if not langs:
        return {"langs": []}
    each = max(1, SAMPLE // len(langs))
    shares = documents.sparkSession.createDataFrame([(x, min(1.0, each / n)) for x, n in counts.items()], "lang string, share double")
    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 50)) / F.lit(float(1 << 50))
    picked = known.withColumn("chance", chance).join(F.broadcast(shares), "lang").where("chance < share").select(as_binary(), "lang")
    rows = map_arrow(picked, _sample, "x binary, lang string").collect()
    if not rows:
        return {"langs": []}
    x = np.stack([np.frombuffer(r[0], np.float16) for r in rows]).astype(np.float32)
    code = codewords(len(langs))
    y = code[[langs.index(r[1]) for r in rows]].astype(np.float32)
    w, b, dw = np.zeros((DIMS, y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32), 0.0
    for _ in range(80):
        g = -y / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30)))
        dw = 0.8 * dw - 8.0 * (x.T @ g / len(x) + 1e-5 * w)
        w, b = w + dw, b - 0.5 * g.mean(axis=0)
    right = ((x @ w + b) * y > 0).mean(axis=0)
    return {"langs": langs, "code": code.astype(np.float32), "w": w, "b": b, "weight": np.maximum(2 * right - 1, 0.01)}


def _predict(batches: Iterator[pa.RecordBatch], model: Broadcast, gap: float) -> Iterator[pa.RecordBatch]:
    m, schema = model.value, arrow_schema("doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")
    for batch in batches:
        texts = text_bytes(batch.column(1))
        pred, score, near = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        for a, b in runs([len(x) + 3000 for x in texts], 1_000_000) if m["langs"] else []:
            margins = histograms(texts[a:b]) @ m["w"] + m["b"]
            losses = np.stack([np.log1p(np.exp(-np.clip(margins * c, -30, 30))) @ m["weight"] for c in m["code"]], axis=1)
            p = np.exp(losses.min(axis=1, keepdims=True) - losses)
            p /= p.sum(axis=1, keepdims=True)
            top = p.argmax(axis=1)
            others = np.sort(p, axis=1)[:, -2] if p.shape[1] > 1 else np.zeros(b - a)
            for i in range(a, b):
                if LETTER.search(texts[i].decode("utf-8", "replace")):
                    pred[i], score[i], near[i] = m["langs"][top[i - a]], p[i - a, top[i - a]], p[i - a, top[i - a]] - others[i - a] < gap
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(pred, pa.string()), pa.array(score), pa.array(near)], schema=schema)


def predict(documents: DataFrame, gap: float = 0.2) -> DataFrame:
    sent = documents.sparkSession.sparkContext.broadcast(fit(documents))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), as_binary(), (crc_mod("doc_id", 5) == 0).alias("held_out"))
    return map_arrow(rows, partial(_predict, model=sent, gap=gap), "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")
