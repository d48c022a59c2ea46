"""Operator 3, chat formatting by token-level assembly.

Segments (role, text) are escaped and encoded apart; reserved ids, which lie beyond
the vocabulary, mark where a turn, its text and its end are, so no content can
forge a mark. The loss mask comes from prefix sums over +1 and -1 at segment edges.
In the text form the marks are control strings; a control string inside a text gets
a backslash after its first character (one more if some are there), which reading
back takes away.

Defined results: null role or text is empty; a null conv_id is a conversation of its
own; equal turns order by role and text. A conversation's turns stream through one
task in order (its digest is a sequential hash); memory doesn't grow with it."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.bpe import SHOWN, encoder
from quarryline.llm.common import arrow_schema, map_arrow, runs, tokenizer_path

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings, ours and those of other common templates.
CONTROL = [TURN, TEXT, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
INSIDE = "|".join(rf"{re.escape(x[0])}(?=\\*{re.escape(x[1:])})" for x in CONTROL)
ESCAPE = re.compile(f"(?:{INSIDE})")
UNESCAPE = re.compile("|".join(rf"(?<={re.escape(x[0])})\\(?=\\*{re.escape(x[1:])})" for x in CONTROL))
FORMATTED = "conv_id long, place long, ids binary, mask binary, chars long"


def escape(text: str) -> str:
    return ESCAPE.sub(lambda m: m.group() + "\\", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub("", text)


@lru_cache(2)
def spellings(path: str) -> list[bytes]:
    back = {c: b for b, c in enumerate(SHOWN)}
    tokenizer = encoder(path, True).tokenizer
    tokens = [tokenizer.id_to_token(i) or "" for i in range(encoder(path, True).size)]
    return [bytes(back[c] for c in x) if all(c in back for c in x) else x.encode() for x in tokens]


def _assemble(batches: Iterator[pa.RecordBatch], path: str, learned: str) -> Iterator[pa.RecordBatch]:
    schema, mark, place = arrow_schema(FORMATTED), encoder(path, True).size, 0
    for batch in batches:
        names = batch.column(0)
        roles, texts = [[escape(x or "") for x in batch.column(i).to_pylist()] for i in (1, 2)]
        is_learned = [x == learned for x in batch.column(1).to_pylist()]
        for a, b in runs([len(x) + len(y) for x, y in zip(roles, texts, strict=True)], 1_000_000):
            ids, counts = encoder(path, True).encode([z for x, y in zip(roles[a:b], texts[a:b], strict=True) for z in (x, y)])
            n = b - a
            # before each role a turn mark, before each text a text mark, after it an end mark
            ends = np.cumsum(counts)
            at = np.concatenate([np.insert(ends[1::2], 0, 0)[:-1], ends[0::2], ends[1::2]])
            order = np.argsort(np.tile(np.arange(n) * 3, 3) + np.repeat([0, 1, 2], n), kind="stable")
            flat = np.insert(ids.astype("<u4"), at[order], np.tile([mark, mark + 1, mark + 2], n))
            sizes = counts[0::2] + counts[1::2] + 3
            first = np.cumsum(sizes) - sizes
            steps = np.zeros(len(flat) + 1, np.int8)
            on = np.array(is_learned[a:b])
            np.add.at(steps, (first + 2 + counts[0::2])[on], 1)
            np.add.at(steps, (first + sizes - 1)[on], -1)
            mask = np.cumsum(steps[:-1]).astype(np.uint8)
            parts = [(flat[i : i + k].tobytes(), mask[i : i + k].tobytes()) for i, k in zip(first.tolist(), sizes.tolist(), strict=True)]
            chars = [len(TURN) + len(TEXT) + len(END) + len(x) + len(y) for x, y in zip(roles[a:b], texts[a:b], strict=True)]
            yield pa.RecordBatch.from_arrays([names.slice(a, n), pa.array(np.arange(place, place + n)), pa.array([x for x, _ in parts], pa.binary()), pa.array([y for _, y in parts], pa.binary()), pa.array(chars, pa.int64())], schema=schema)
            place += n


def format_conversations(conversations: DataFrame, path: str | None = None, learned: str = "assistant") -> DataFrame:
    """Per turn, in order within a partition that holds whole conversations:
    conv_id, place (ascending in the partition), ids (little-endian unsigned 32-bit), mask (a byte an id), chars of the text form."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), "turn")
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return map_arrow(ordered, partial(_assemble, path=path or tokenizer_path(), learned=learned), FORMATTED)


def text_form(ids: np.ndarray, path: str) -> tuple[str, str]:
    """Role and text of a formatted turn, still escaped."""
    mark, spell = encoder(path, True).size, spellings(path)
    cut = int(np.flatnonzero(ids == mark + 1)[0])
    if ids[0] != mark or ids[-1] != mark + 2:
        raise ValueError("not a turn")
    role, text = (b"".join(spell[i] for i in x.tolist()).decode("utf-8", "replace") for x in (ids[1:cut], ids[cut + 1 : -1]))
    return role, text


REPORT = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_back(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    schema, spell, now, state = arrow_schema(REPORT), spellings(path), None, None

    def done() -> list:
        return [now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]]

    for batch in batches:
        rows = []
        for conv, _, ids, mask, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if state is None or conv != now:
                if state:
                    rows.append(done())
                now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            tokens = np.frombuffer(ids, "<u4")
            role, text = text_form(tokens, path)
            state[0] += 1
            state[1].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
            learned = b"".join(spell[i] for i in tokens[np.frombuffer(mask, np.uint8) > 0].tolist())
            kept = unescape(learned.decode("utf-8", "replace"))
            state[2] += len(kept)
            state[3].update(kept.encode())
            state[4] += len(TURN) + len(TEXT) + len(END) + len(role) + len(text)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(done(), schema, strict=True)], schema=schema)


def report(conversations: DataFrame, path: str | None = None) -> DataFrame:
    path = path or tokenizer_path()
    return map_arrow(format_conversations(conversations, path), partial(_read_back, path=path), REPORT)
