"""What operators 7 and 9 share: span lists per document, their digests, and redaction."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import as_binary, map_arrow, text_strings

Span = tuple[str, int, int]


def in_order(spans: list[Span], kinds: list[str]) -> str:
    """kind:start:end by start, then kind as listed, then end; comma-joined."""
    rank = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(set(spans), key=lambda x: (x[1], rank[x[0]], x[2])))


def _digest(batches: Iterator[pa.RecordBatch], find: Callable[[str], list[Span]], base: list[str], kinds: list[str]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", *(f"n_{k}" for k in base), "base_sha256", "spans"]
    types = [pa.int64()] * (1 + len(base)) + [pa.string()] * 2
    for batch in batches:
        found = [find(x) for x in text_strings(batch.column(1))]
        counts = [pa.array([sum(s[0] == k for s in x) for x in found], pa.int64()) for k in base]
        sha = [hashlib.sha256(in_order([s for s in x if s[0] in base], kinds).encode()).hexdigest() for x in found]
        yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(sha, pa.string()), pa.array([in_order(x, kinds) for x in found], pa.string())], schema=pa.schema(list(zip(names, types, strict=True))))


def digest(documents: DataFrame, find: Callable[[str], list[Span]], base: list[str], kinds: list[str]) -> DataFrame:
    spec = ", ".join(["doc_id long", *(f"n_{k} long" for k in base), "base_sha256 string", "spans string"])
    return map_arrow(documents.select(F.col("doc_id").cast("long").alias("doc_id"), as_binary()), partial(_digest, find=find, base=base, kinds=kinds), spec)


def redacted(text: str, spans: list[Span]) -> str:
    """Spans replaced by [KIND]; overlapping ones by the first one's kind."""
    out, upto = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= upto:
            out += [text[upto:a], f"[{kind.upper()}]"]
        upto = max(upto, b)
    return "".join([*out, text[upto:]])


def _redact(batches: Iterator[pa.RecordBatch], find: Callable[[str], list[Span]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("text")
        texts = [x if x is None else redacted(x, found) if (found := find(x)) else x for x in batch.column(at).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(texts, batch.schema.field(at).type) if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)


def redact(documents: DataFrame, find: Callable[[str], list[Span]]) -> DataFrame:
    """All documents and columns; texts without spans stay as they are."""
    return map_arrow(documents, partial(_redact, find=find), documents.schema)
