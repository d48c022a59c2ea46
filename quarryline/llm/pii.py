"""Operator 9, personal data by anchor expansion.

An Aho-Corasick automaton finds anchors (at-signs, plus signs, schemes, digits, cues of
identifiers); parsers expand each anchor to both sides and validate what they get.
A digit expands to its run; addresses of machines and cards are parsed from runs. All of it
is linear in the text's length: no pattern is tried again from inside a match.

Added spans: ``url`` (a scheme with user and password before a host), ``iban``
(after its cue, check digits valid), ``ssn`` (after its cue).

Defined results: null and empty texts have no spans. Repeated rows each give a row.
Places are code points."""

from __future__ import annotations

import re
import string
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame

from quarryline.llm.spans import Span, digest, redact

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "url", "iban", "ssn"]
LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
RUN = re.compile(r"[0-9]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
PHONE = re.compile(r"[0-9][ ().0-9-]++")
CREDENTIALS = re.compile(r"://[^\s/@:]++:[^\s/@]++@[A-Za-z0-9.-]++")
IBAN = re.compile(r"[ :#]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
#: Countries and the lengths of their IBANs.
LENGTHS = {
    x[:2]: int(x[2:])
    for x in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 "
        "GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 "
        "MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 "
        "TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
    ).split()
}
SSN = re.compile(r"[ :#]{0,3}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")


@lru_cache(1)
def anchors() -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for word, kind in ({"@": "email", "+": "phone", "://": "url", "IBAN": "iban", "SSN": "ssn"} | dict.fromkeys(string.digits, "digit")).items():
        machine.add_word(word, kind)
    machine.make_automaton()
    return machine


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _numbers(text: str, runs: list[tuple[int, int]]) -> list[Span]:
    """runs: where digits are, in order."""
    out: list[Span] = []
    i = 0
    while i + 3 < len(runs):
        parts = runs[i : i + 4]
        if all(a[1] + 1 == b[0] and text[a[1]] == "." for a, b in zip(parts, parts[1:], strict=False)):
            if all(len(text[a:b].lstrip("0")) <= 3 and int(text[a:b].lstrip("0") or "0") <= 255 for a, b in parts):
                out.append(("ip", parts[0][0], parts[3][1]))
            i += 4
        else:
            i += 1
    i = 0
    while i < len(runs):
        j, n = i, runs[i][1] - runs[i][0]
        while j + 1 < len(runs) and runs[j + 1][0] == runs[j][1] + 1 and text[runs[j][1]] in " -":
            j += 1
            n += runs[j][1] - runs[j][0]
        if 14 <= n <= 19 and luhn("".join(text[a:b] for a, b in runs[i : j + 1])):
            out.append(("card", runs[i][0], runs[j][1]))
        i = j + 1
    return out


def _valid_iban(found: str) -> bool:
    code = found.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


@lru_cache(None)
def _iban_of(length: int) -> re.Pattern:
    return re.compile(rf"[ :#]{{0,3}}([A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{{length - 4}}})(?![A-Za-z0-9])")


def _iban(text: str, at: int) -> re.Match | None:
    """Of the country's length, so that words after it don't count; else as far as it goes."""
    country = re.compile(r"[ :#]{0,3}([A-Z]{2})").match(text, at)
    patterns = [_iban_of(LENGTHS[country[1]])] if country and country[1] in LENGTHS else []
    return next((m for p in [*patterns, IBAN] if (m := p.match(text, at)) and _valid_iban(m[1])), None)


def find(text: str) -> list[Span]:
    out: list[Span] = []
    runs: list[tuple[int, int]] = []
    mail = phone = run = 0  # ends of the last matches of these kinds
    for last, kind in anchors().iter(text):
        if kind == "digit":
            if last >= run:
                runs.append(RUN.match(text, last).span())
                run = runs[-1][1]
        elif kind == "email":
            start = last
            while start > mail and text[start - 1] in LOCAL:
                start -= 1
            if start < last and (m := DOMAIN.match(text, last + 1)):
                out.append(("email", start, m.end()))
                mail = m.end()
        elif kind == "phone":
            if last >= phone and (m := PHONE.match(text, last + 1)):
                body = m.group().rstrip(" ().-")
                if len(body) >= 3:
                    phone = last + 1 + len(body)
                    if 10 <= sum(c in "0123456789" for c in body) <= 15:
                        out.append(("phone", last, phone))
        elif kind == "url":
            if m := CREDENTIALS.match(text, last - 2):
                start = last - 2
                while start > 0 and last - start < 20 and text[start - 1] in string.ascii_letters:
                    start -= 1
                out.append(("url", start, m.end()))
        elif m := _iban(text, last + 1) if kind == "iban" else SSN.match(text, last + 1):
            out.append((kind, *m.span(1)))
    return out + _numbers(text, runs)


def report(documents: DataFrame) -> DataFrame:
    return digest(documents, find, BASE, KINDS)


def remove(documents: DataFrame) -> DataFrame:
    return redact(documents, find)
