"""Personal data in whole texts, disguised forms included, with offsets into the source text.

Plain detectors run on the source. Where a text holds look-alike characters, spelled digits or at/dot disguises, rewriting
steps normalise it; each step keeps an alignment, the detectors run on the rewritten text, and every new span is mapped
back through the alignments to source characters. Spans found on the source itself always stay.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import text_batches, tidied

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a match inside a run of digits would begin at its start
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NON_DIGIT = re.compile(r"[^0-9]")


def _emails(text: str) -> Iterator[Span]:
    """From each @ outwards, so a long run without one costs nothing."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield "email", start, m.end()
            floor = m.end()
        at = text.find("@", max(at + 1, floor))


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def detect(text: str) -> list[Span]:
    """Spans (kind, start, end) by start, then kind: per kind leftmost and non-overlapping; failing matches drop without retries."""
    found = list(_emails(text))
    if "." in text:
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(d := p.lstrip("0")) < 4 and int(d or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _NON_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NON_DIGIT.sub("", m[0])) <= 15]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


class Aligned:
    """A text and, for each stretch of it, the source stretch it stands for."""

    def __init__(self, source: str, edits: list[tuple[int, int, str]]):
        """edits: (start, end, replacement), sorted and apart."""
        out, self.at, self.start, self.end, self.copied = [], [], [], [], []
        here = size = 0

        def piece(text: str, start: int, end: int, copied: bool) -> None:
            nonlocal size
            if text:
                out.append(text)
                self.at.append(size)
                self.start.append(start)
                self.end.append(end)
                self.copied.append(copied)
                size += len(text)

        for start, end, new in edits:
            piece(source[here:start], here, start, True)
            piece(new, start, end, False)
            here = end
        piece(source[here:], here, len(source), True)
        self.text = "".join(out)

    def source_span(self, start: int, end: int) -> tuple[int, int]:
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        first = self.start[i] + (start - self.at[i]) if self.copied[i] else self.start[i]
        last = self.start[j] + (end - self.at[j]) if self.copied[j] else self.end[j]
        return first, last


# Letters of other alphabets that look like Latin ones, then spelled digits in four languages.
LOOK_ALIKES = dict(zip("АВЕЅІЈКМНОРСТХаеѕіјорсухԁѵΑΒΕΖΗΙΚΜΝΟΡΤΥΧονικ", "ABESIJKMHOPCTXaesijopcyxdvABEZHIKMNOPTYXovik", strict=True)) | {
    "。": ".", "․": ".", "−": "-", "‐": "-", "‑": "-", "‒": "-", "–": "-", " ": " ", " ": " ", " ": " ", "﹫": "@",
    "​": "", "‌": "", "‍": "", "⁠": "", "﻿": "", "­": "",
}
DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "oh": "0",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}


def _fold_table() -> dict[str, str]:
    """LOOK_ALIKES, all decimal digits of other scripts, and what compatibility normalisation makes one ASCII character."""
    table = dict(LOOK_ALIKES)
    for cp in [*range(0x0660, 0x10000), *range(0x1D400, 0x1D800)]:
        ch = chr(cp)
        digit = unicodedata.decimal(ch, None)
        new = str(digit) if digit is not None else unicodedata.normalize("NFKC", ch)
        if ch not in table and len(new) == 1 and " " < new <= "~":
            table[ch] = new
    return table


FOLD = _fold_table()
_FOLD = re.compile("[" + "".join(map(re.escape, sorted(FOLD))) + "]")
_WORD = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + ")"
_DOT = "(?:dot|punto|punkt|point)"
_AT = "(?:at|arroba)"
_OPEN, _CLOSE = r"[ \t]{0,3}[\[({<][ \t]{0,3}", r"[ \t]{0,3}[\])}>][ \t]{0,3}"
_BRACKET_DOT = rf"{_OPEN}(?:{_DOT}|\.){_CLOSE}"
_SAID_DOT = rf"(?:{_BRACKET_DOT}|[ ]{_DOT}[ ])"
_SAID_DIGIT = rf"(?:{_WORD}|[0-9]{{1,19}})"
_SPELLED = rf"\b(?:plus[ ,-]{{1,3}})?{_SAID_DIGIT}(?:(?:[ ,-]{{1,3}}|{_SAID_DOT}){_SAID_DIGIT}){{3,}}\b"
_RUN = re.compile(_SPELLED, re.I)
_PART = re.compile(rf"(?P<plus>plus[ ,-]+)|(?P<dot>{_SAID_DOT})|(?P<word>{_WORD}(?![^\W\d_]))|(?P<digits>[0-9]+)|(?P<gap>[ ,-]+)", re.I)
_AT_SIGN = re.compile(rf"(?P<bracket>{_OPEN}(?:{_AT}|@){_CLOSE})|(?P<said>[ ]{_AT}[ ])|(?P<sign>[ ]?@[ ]?)", re.I)
_DOMAIN_SAID = re.compile(rf"[A-Za-z0-9-]+(?:(?:\.|{_SAID_DOT})[A-Za-z0-9-]+)+", re.I)
_DOT_BEFORE = re.compile(rf"{_SAID_DOT}\Z", re.I)
#: The longest a dot in words or brackets can be.
_DOT_MOST = 16
_ODD_LOCAL = re.compile(r"[0-9._%+-]")
_SAID_DOTS, _BRACKET_DOTS = re.compile(_SAID_DOT, re.I), re.compile(_BRACKET_DOT, re.I)
#: Letters that stand in for 0 and 1 among digits.
_LETTER_DIGITS = {"O": "0", "o": "0", "l": "1", "I": "1"}
_MIXED = re.compile(r"(?<![A-Za-z0-9])[0-9OolI](?:[\x20().-]{0,2}[0-9OolI]){8,}(?![A-Za-z0-9])")
_MIXED_HINT = r"[0-9][OolI]|[OolI][0-9]"
#: What sends a text down the slow path, for the vectorised search over a batch: any fold character, run or disguise.
TRIGGER = "(?i:" + "|".join([
    rf"[{''.join(sorted(re.escape(c) for c in FOLD))}]", _SPELLED, rf"[\[({{<][ \t]{{0,3}}(?:{_AT}|{_DOT}|@|\.)[ \t]{{0,3}}[\])}}>]",
    rf" {_AT} [a-z0-9-]+(?:\.|[ ]{_DOT}[ ])[a-z0-9]", rf" @|@ |@[a-z0-9.-]+[ ]{_DOT}[ ]",
]) + ")|" + _MIXED_HINT
def fold_edits(text: str) -> list[tuple[int, int, str]]:
    return [] if text.isascii() else [(*m.span(), FOLD[m[0]]) for m in _FOLD.finditer(text)]


def letter_edits(text: str) -> list[tuple[int, int, str]]:
    """O, o, l and I in runs that are digits for the most part."""
    edits = []
    for m in _MIXED.finditer(text):
        letters = [i for i in range(*m.span()) if text[i] in _LETTER_DIGITS]
        if 0 < 3 * len(letters) <= sum(c.isdigit() for c in m[0]) + len(letters):
            edits += [(i, i + 1, _LETTER_DIGITS[text[i]]) for i in letters]
    return edits


def spelled_edits(text: str) -> list[tuple[int, int, str]]:
    """Runs of four or more spelled or written digits, if a digit or a dot in them is spelled."""
    edits = []
    for run in _RUN.finditer(text):
        parts = [(m.lastgroup, m) for m in _PART.finditer(text, *run.span())]
        if all(kind in ("digits", "gap") for kind, _ in parts):
            continue
        for kind, m in parts:
            if kind != "digits":
                new = {"plus": "+", "dot": ".", "gap": ""}.get(kind)
                edits.append((*m.span(), DIGIT_WORDS[m[0].lower()] if new is None else new))
    return edits


def _local_start(text: str, end: int) -> int:
    """Where the local part that ends at `end` starts, its dots in words or brackets included; `end` if there is none. Goes back
    as far as the part goes, so its cost is the part's length."""
    start = end
    while True:
        here = start
        while here > 0 and text[here - 1] in _LOCAL:
            here -= 1
        if here == start:  # no letters before what was taken for a dot
            return end if start == end else before
        start = here
        dot = _DOT_BEFORE.search(text, max(0, start - _DOT_MOST), start)
        if not dot:
            return start
        before, start = start, dot.start()


def disguise_edits(text: str) -> list[tuple[int, int, str]]:
    """At and dot in brackets or as words. A bare word "at" needs a spelled dot, or a name that isn't a plain word, beside it."""
    edits, reached = [(*m.span(), ".") for m in _BRACKET_DOTS.finditer(text)], 0
    for m in _AT_SIGN.finditer(text):
        domain = _DOMAIN_SAID.match(text, m.end())
        start = max(reached, _local_start(text, m.start())) if domain else m.start()
        if start >= m.start():
            continue
        reached = m.end()
        here = [(*d.span(), ".") for d in _SAID_DOTS.finditer(text, start, m.start())]
        there = [(*d.span(), ".") for d in _SAID_DOTS.finditer(text, *domain.span())]
        odd = m.lastgroup == "bracket" or here or there or m.lastgroup == "sign" and len(m[0]) > 1
        if odd or m.lastgroup == "said" and _ODD_LOCAL.search(text, start, m.start()):
            edits += [*here, (*m.span(), "@"), *there]
    apart, reached = [], 0
    for e in sorted(set(edits)):
        if e[0] >= reached:
            apart.append(e)
            reached = e[1]
    return apart


def disguised(text: str, base: list[Span]) -> list[Span]:
    """Spans that only show after rewriting, in source characters, none over a base span of its kind."""
    layers, now = [], text
    for step in (fold_edits, letter_edits, spelled_edits, disguise_edits):
        if edits := step(now):
            layers.append(Aligned(now, edits))
            now = layers[-1].text
    added = []
    for kind, start, end in detect(now) if layers else []:
        for layer in reversed(layers):
            start, end = layer.source_span(start, end)
        if all(k != kind or end <= s or e <= start for k, s, e in base):
            added.append((kind, start, end))
    return added


def find_spans(text: str, triggered: bool = True) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by start, then kind."""
    base = detect(text)
    added = disguised(text, base) if triggered else []
    return base, sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0]), s[2])) if added else base


def listing(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str, spans: list[Span]) -> str:
    """text with each span as its kind in brackets; of overlapping spans the first names the whole stretch."""
    edits: list[list] = []
    for kind, start, end in spans:
        if edits and start < edits[-1][1]:
            edits[-1][1] = max(edits[-1][1], end)
        else:
            edits.append([start, end, f"[{kind.upper()}]"])
    return Aligned(text, [tuple(e) for e in edits]).text if edits else text


def _scan(batches: Iterator[pa.RecordBatch], rewrite: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pc.fill_null(batch.column(1), "")
        hot = pc.match_substring_regex(texts, TRIGGER).to_pylist()
        found = [find_spans(t, h) for t, h in zip(texts.to_pylist(), hot, strict=True)]
        if rewrite:
            yield pa.record_batch([batch.column(0), pa.array([None if t is None else redact(t, f[1]) for t, f in zip(batch.column(1).to_pylist(), found, strict=True)], pa.string())], ["row", "text"])
            continue
        n = {k: pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS}
        digests = [hashlib.sha256(listing(base).encode()).hexdigest() for base, _ in found]
        cols = [batch.column(0), *n.values(), pa.array(digests, pa.string()), pa.array([listing(f) for _, f in found], pa.string()), pa.array([len(f) - len(b) for b, f in found], pa.int64()), pa.array([len(f) for _, f in found], pa.int64())]
        yield pa.record_batch(cols, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_disguised", "n_spans"])


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_disguised, n_spans.

    A null text counts as empty and has no spans; a null id stays null; repeated rows are repeated; other columns aren't read.
    Offsets are code points, end exclusive. Work per text is linear in its length; no shuffle.
    """
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_disguised long, n_spans long"
    text_batches(docs.sparkSession)
    return own.mapInArrow(tidied(lambda it: _scan(it, False)), schema)


def redact_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span in text_col replaced by its kind; null texts stay null, all other columns as they are."""
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (clean,) = _scan(iter([pa.record_batch([b.column(at), b.column(at)], ["row", "text"])]), True)
            yield pa.RecordBatch.from_arrays([clean.column(1) if i == at else b.column(i) for i in range(len(names))], names=names)

    text_batches(docs.sparkSession)
    return docs.mapInArrow(tidied(run), docs.schema)

