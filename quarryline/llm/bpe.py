"""Byte-level BPE over many texts: the same ids as the tokenizers library gives.

The library spends nearly all its time on pieces (a word with the space before
it) that it has met before. Here numpy splits all texts of a chunk into pieces at
once, pieces are looked up in a table by a 64-bit hash, and only pieces that the
table lacks go to the library. Texts with characters whose class isn't settled in
every Unicode version go to the library whole, as do all texts when the tokenizer
file isn't a plain byte-level BPE. Strings of special tokens are encoded as the library
does by default; an ``ordinary`` encoder takes them for text like any other."""

from __future__ import annotations

import json
import os
import unicodedata
from functools import lru_cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a worker for each core

from tokenizers import Tokenizer

from quarryline.llm.common import runs, span_hashes

OTHER, LETTER, NUMBER, SPACE, BREAK, END, UNSURE = range(7)
#: Unicode's White_Space besides the space.
WHITE = [*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: No text may hold it, it stands after each text.
SENTINEL = 0xFFFF
CHUNK = 400_000


def _shown() -> str:
    """The character that byte-level BPE shows for each byte: the byte's own where
    Latin-1 prints it, else the next one from U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return "".join(chr(b) if b in own else chr(next(others)) for b in range(256))


SHOWN = _shown()


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point. Sure are those that Unicode 3.2 had with the
    same class as today, and emoji, which are in none of the classes that matter."""
    table = np.full(0x110000, UNSURE, np.uint8)
    old = unicodedata.ucd_3_2_0.category
    for c in range(0xFFFE):
        now, then = unicodedata.category(chr(c)), old(chr(c))
        if now[0] == then[0] and now != "Cn" and now != "Cs" and c != 0x180E:
            table[c] = {"L": LETTER, "N": NUMBER}.get(now[0], OTHER)
    table[0x1F300:0x1FAFF] = OTHER
    table[WHITE] = BREAK
    table[32] = SPACE
    table[SENTINEL] = END
    return table


class Table:
    """Open addressing from piece hashes to places in an array of ids; bounded."""

    def __init__(self, bits: int = 20):
        self.bits = bits
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.place = np.zeros(1 << self.bits, np.int32)
        self.count = np.zeros(1 << self.bits, np.int32)
        self.ids = np.empty(1 << 16, np.uint32)
        self.filled = self.entries = 0

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for those that aren't there."""
        mask = np.int64((1 << self.bits) - 1)
        at = (keys >> np.uint64(8)).astype(np.int64) & mask
        found = self.keys[at]
        out = np.where(found == keys, at, -1)
        left = np.flatnonzero((found != keys) & (found != 0))
        while len(left):
            at[left] = (at[left] + 1) & mask
            found = self.keys[at[left]]
            hit = found == keys[left]
            out[left[hit]] = at[left[hit]]
            left = left[~hit & (found != 0)]
        return out

    def add(self, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """keys: distinct, and none of them there."""
        while self.filled + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.filled : self.filled + len(ids)] = ids
        places = self.filled + np.cumsum(counts) - counts
        self.filled += len(ids)
        self.entries += len(keys)
        mask = np.int64((1 << self.bits) - 1)
        at, left = (keys >> np.uint64(8)).astype(np.int64) & mask, np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] == 0]
            self.keys[at[free]] = keys[free]
            won = left[self.keys[at[left]] == keys[left]]
            self.place[at[won]], self.count[at[won]] = places[won], counts[won]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & mask


class Encoder:
    def __init__(self, path: str, ordinary: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = ordinary
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and not spec["model"].get("dropout") and spec["model"]["type"] == "BPE"
        self.special = [] if ordinary else [x["content"] for x in spec.get("added_tokens") or []]
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.model = self.tokenizer.model
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)  # our table holds what its cache would
        self.table = Table()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the number of ids of each text."""
        ids, counts = [], []
        for a, b in runs([len(x) + 1 for x in texts], CHUNK):
            found = self._chunk(texts[a:b])
            ids.append(found[0])
            counts.append(found[1])
        return np.concatenate([np.empty(0, np.uint32), *ids]), np.concatenate([np.empty(0, np.int64), *counts])

    def _by_library(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        whole: dict[int, list[int]] = {}
        if not self.plain:
            whole = dict(enumerate(self._by_library(texts)))
        elif marked := [i for i, x in enumerate(texts) if any(y in x for y in self.special)]:
            whole = dict(zip(marked, self._by_library([texts[i] for i in marked]), strict=True))
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        lasts = np.cumsum(sizes + 1) - 1
        joined = "￿".join([*texts, ""])
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = classes()[codes]
        if len(whole) < len(texts) and ((kinds == UNSURE).any() or np.count_nonzero(kinds == END) > len(texts)):
            odd = kinds == UNSURE
            odd |= kinds == END
            odd[lasts] = False
            at = [i for i in np.unique(np.searchsorted(lasts, np.flatnonzero(odd))).tolist() if i not in whole]
            whole |= dict(zip(at, self._by_library([texts[i] for i in at]), strict=True))
        if whole:
            rest = [i for i in range(len(texts)) if i not in whole]
            ids, counts = self._chunk([texts[i] for i in rest]) if rest else (np.empty(0, np.uint32), np.empty(0, np.int64))
            parts = dict(zip(rest, np.split(ids, np.cumsum(counts)[:-1]), strict=True)) if rest else {}
            parts |= {i: np.array(x, np.uint32) for i, x in whole.items()}
            found = [parts[i] for i in range(len(texts))]
            return np.concatenate(found), np.fromiter(map(len, found), np.int64, len(found))
        starts = self._starts(codes, kinds)
        ends = np.append(starts[1:], len(codes))
        real = kinds[starts] != END
        keys = span_hashes(codes, starts, ends)
        keys[keys == 0] = 1
        slots = self.table.slots(keys)
        if (missing := real & (slots < 0)).any():
            self._learn(joined, starts, ends, keys, np.flatnonzero(missing))
            slots = np.where(missing, self.table.slots(keys), slots) if not self.cleared else self.table.slots(keys)
        counts = np.where(real & (slots >= 0), self.table.count[slots], 0).astype(np.int64)
        places = self.table.place[slots].astype(np.int64)
        shift = np.cumsum(counts) - counts
        ids = self.table.ids[np.repeat(places - shift, counts) + np.arange(int(counts.sum()))]
        totals = np.cumsum(counts)[~real]
        return ids, np.diff(totals, prepend=0)

    def _learn(self, joined: str, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray, missing: np.ndarray) -> None:
        _, first = np.unique(keys[missing], return_index=True)
        at = missing[first]
        self.cleared = (self.table.entries + len(at)) * 2 > len(self.table.keys)
        if self.cleared:  # all pieces of this chunk are learned again, so that all are there
            self.table.clear()
            _, at = np.unique(keys, return_index=True)
            if len(at) * 2 > len(self.table.keys):
                self.table = Table(self.table.bits + 1 + len(at).bit_length() - self.table.bits)
        pieces = [joined[a:b].encode("utf-8", "replace").decode("latin-1").translate(SHOWN) for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        found = [[t.id for t in self.model.tokenize(x)] for x in pieces]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        self.table.add(keys[at], np.fromiter((x for y in found for x in y), np.uint32, int(counts.sum())), counts)

    @staticmethod
    def _starts(codes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Where pieces start. Runs of letters, of numbers, of other characters and
        of white space are pieces; the last of several white characters before
        another run is split off, and goes with that run if it is a space; an
        apostrophe may take a short ending with it."""
        groups = kinds.copy()
        groups[groups == BREAK] = SPACE
        is_start = np.empty(len(codes) + 1, bool)
        is_start[0] = True
        np.not_equal(groups[1:], groups[:-1], out=is_start[1:-1])
        is_start[-1] = True
        is_start[:-1][kinds == END] = True
        white = groups == SPACE
        last = np.flatnonzero(white[:-1] & ~white[1:] & (kinds[1:] != END))
        is_start[last] = True
        is_start[last[kinds[last] == SPACE] + 1] = False
        quotes = np.flatnonzero((codes == 39) & is_start[:-1])
        if len(quotes):
            padded = np.append(codes, [0, 0])
            one, two = padded[quotes + 1], padded[quotes + 2]
            short = np.isin(one, [ord(x) for x in "stmd"])
            long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            for which, n in ((short, 1), (long, 2)):
                is_start[quotes[which] + 1] = False
                is_start[quotes[which] + 1 + n] = True
        return np.flatnonzero(is_start[:-1])


@lru_cache(2)
def encoder(path: str, ordinary: bool = False) -> Encoder:
    """One for each Python worker."""
    return Encoder(path, ordinary)
