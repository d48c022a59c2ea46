"""Operator 7, secret scans.

Base spans come from fixed patterns. Other strings in a sensitive context are
measured by dictionary-primed zstandard: a candidate's marginal size is what it
adds to the compressed size of its surroundings, with identifiers and common words
as the dictionary. What hardly compresses below its alphabet's own size is
reported as ``novel``: the whole run of parts joined by dots, whatever its length.
Copies of what is measured don't count as its surroundings.

Defined results: null and empty texts have no spans. Repeated rows each give a row.
Places are code points. Letter case counts in ASCII only."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import zstandard
from pyspark.sql import DataFrame

from quarryline.llm.spans import Span, digest, redact

BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "novel"]
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}+")
SENSITIVE = re.compile(r"(?:passw|secret|token|api[_-]?key|credential|authorization|bearer|private[_-]?key|access[_-]?key)[a-z_]{0,12}", re.I | re.A)
FIRST = re.compile(r"[A-Za-z0-9+/_=-]")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]++(?:\.[A-Za-z0-9+/_=-]++)*+")
PART = re.compile(r"[A-Za-z0-9+/_=-]{20,}+")
PLAIN = re.compile(r"[A-Za-z0-9]{20,}+")
#: A candidate starts up to REACH characters after a cue and has a PART; AROUND characters of both sides are its surroundings.
REACH, AROUND = 48, 200
#: Identifiers and words that code and prose are full of.
IDENTIFIERS = (
    "return function import export default const class public private static void string number boolean undefined null true false self this "
    "password secret token api_key apikey access_key client_id client_secret username config settings environment authorization bearer "
    "http https www example com localhost server database connection request response header content application json value "
    "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 00000000000000000000 xxxxxxxxxxxxxxxxxxxx -------------------- ===================="
)


@lru_cache(1)
def compressor() -> zstandard.ZstdCompressor:
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False, write_checksum=False)


def novelty(context: str, candidate: str) -> float:
    """Marginal compressed bytes over what random text of the same alphabet takes."""
    pack = compressor().compress
    around = context.encode("utf-8", "replace")
    extra = len(pack(around + b" " + candidate.encode())) - len(pack(around))
    return extra / max(1.0, len(candidate) * math.log2(max(2, len(set(candidate)))) / 8)


def _mixed(x: str) -> bool:
    return any(c.isdigit() for c in x) and any(c.isalpha() for c in x)


def _novel(text: str, start: int, end: int, least: float) -> bool:
    """Measured without other copies of the same string beside it."""
    found, blank = text[start:end], "\0" * (end - start)
    reach = AROUND + len(found)  # whole copies that reach into the surroundings
    before = text[max(0, start - reach) : start].replace(found, blank)[-AROUND:]
    after = text[end : end + reach].replace(found, blank)[:AROUND]
    return novelty((before + after).replace("\0", ""), found) >= least


def _candidates(text: str) -> Iterator[tuple[int, int]]:
    """Runs of parts joined by dots, whole, that start soon after a cue."""
    upto = 0
    for cue in SENSITIVE.finditer(text):
        at = max(upto, cue.end())
        while first := FIRST.search(text, at, cue.end() + REACH + 1):
            yield first.start(), (at := CANDIDATE.match(text, first.start()).end())
        upto = max(upto, at)


def _pieces(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """What is measured of a candidate: all of it, then what may be novel beside familiar parts."""
    yield start, end
    for pattern in (PART, PLAIN):
        for part in pattern.finditer(text, start, end):
            yield part.span()
    if end - start > AROUND:
        for a in [*range(start, end - AROUND, AROUND), end - AROUND]:
            yield a, a + AROUND


def find(text: str, least: float = 0.9) -> list[Span]:
    out: list[Span] = []
    low = text.lower()
    sensitive = any(k in low for k in ("passw", "secret", "token", "api", "credential", "authorization", "bearer", "private", "access"))
    if sensitive:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    if sensitive:
        base = sorted(x[1:] for x in out)
        starts, ends = [x for x, _ in base], list(accumulate((y for _, y in base), max))
        known = lambda a, b: (i := bisect_right(starts, a)) > 0 and b <= ends[i - 1]
        for start, end in _candidates(text):
            if any(_mixed(m.group()) and not known(*m.span()) for m in PART.finditer(text, start, end)):
                if any(_mixed(text[a:b]) and not known(a, b) and _novel(text, a, b, least) for a, b in dict.fromkeys(_pieces(text, start, end))):
                    out.append(("novel", start, end))
    return out


def report(documents: DataFrame) -> DataFrame:
    return digest(documents, find, BASE, KINDS)


def remove(documents: DataFrame) -> DataFrame:
    return redact(documents, find)
