"""Secret scan: fixed patterns, and windows of high Shannon entropy in candidate strings.

Every whole text is scanned as UTF-8 bytes; spans are reported in code points,
end exclusive. Fixed patterns give the kinds ``assign``, ``access`` and ``hex``.
Candidate strings are runs of at least ``MIN_CANDIDATE`` token characters. In
each of their runs of one character class a window slides along, the longest of
the class's windows that the run holds; its symbol counts are updated by the
byte that enters and the byte that leaves, so a step costs the same whatever
the window's length. Windows at or above that window's entropy are united to
spans of kind ``entropy_<class>``. What an allow-list pattern matches, and the
letters and digits that it is part of, is cut out of its candidate before, so it
suppresses no other part of it; a candidate that is an allow-list string gives
no entropy spans. Spans of the fixed patterns are never suppressed.

Defined results: a null text counts as empty and has no spans; texts without
matches give an empty list; an empty table an empty result. Each row is handled
by itself, so repeated rows give equal results; no other column is read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import releasing

MIN_CANDIDATE = 16

#: Needles of which an assignment must hold one; a cheap test before the pattern.
_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{32,}")
_CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-]{%d,}" % MIN_CANDIDATE)
_REST = re.compile(rb"[A-Za-z0-9]*")


def _marks(chars: bytes) -> bytes:
    """Translation that keeps only whether a byte is one of ``chars``."""
    return bytes(0x78 if b in chars else 0x20 for b in range(256))


_DIGITS, _LOWER, _UPPER = b"0123456789", bytes(range(97, 123)), bytes(range(65, 91))
_ALNUM = frozenset(_DIGITS + _LOWER + _UPPER)
_HEX_MARKS, _TOKEN_MARKS = _marks(_DIGITS + b"abcdef"), _marks(_DIGITS + _LOWER + _UPPER + b"+/_=-")


@dataclass(frozen=True)
class EntropyClass:
    """Characters of a class, its window, the least bits per symbol, and what a span must hold.

    ``shorter`` are further windows and their least bits, longest first, for runs that don't hold the window.
    """

    name: str
    run: str
    window: int
    min_bits: float
    needs: tuple[str, ...]
    shorter: tuple[tuple[int, float], ...] = ()

    def fitting(self, length: int) -> tuple[int, float] | None:
        """The longest window that a run of this length holds, and its least bits."""
        return next((w for w in ((self.window, self.min_bits), *self.shorter) if w[0] <= length), None)


#: The shorter windows' least bits, and all of base36 and base32, miss about 1 of 100 random strings of the window's length.
CLASSES = (
    EntropyClass("hex", "[0-9a-fA-F]+", 24, 3.1, ("[0-9]", "[a-fA-F]"), ((20, 2.88), (16, 2.68))),
    EntropyClass("base64", "[A-Za-z0-9+/_=-]+", 24, 4.0, ("[0-9]", "[a-z]", "[A-Z]"), ((20, 3.65), (16, 3.38))),
    EntropyClass("base36", "[a-z0-9]+", 24, 3.6, ("[0-9]", "[g-z]"), ((20, 3.4), (16, 3.12))),
    EntropyClass("base32", "[A-Z0-9]+", 24, 3.52, ("[0-9]", "[G-Z]"), ((20, 3.34), (16, 3.08))),
)
ALLOW_PATTERNS = (
    "(?i)example|placeholder|changeme|dummy|redacted|your[-_]",
    r"(?i)(?<![0-9a-f])[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}(?![0-9a-f])",
    "(?i)abcdefghijklm|0123456789abcdef",
)
BASE_KINDS = ("assign", "access", "hex")


def high_windows(run: bytes, window: int, min_bits: float) -> list[tuple[int, int]]:
    """United spans of all windows whose entropy is at least ``min_bits``.

    c * log2(c) is held as an integer, so the running sum has no drift.
    """
    one = 1 << 40
    cost = [0, *(round(c * log2(c) * one) for c in range(1, window + 1))]
    most = (log2(window) - min_bits) * window * one  # entropy = log2(n) - sum(c log2 c) / n
    counts, total, spans = [0] * 256, 0, []
    for i, b in enumerate(run):
        c = counts[b]
        counts[b] = c + 1
        total += cost[min(c + 1, window)] - cost[c]
        if i >= window - 1:
            if total <= most:
                start = i - window + 1
                if spans and start <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], i + 1)
                else:
                    spans.append((start, i + 1))
            out = run[i - window + 1]
            c = counts[out]
            counts[out] = c - 1
            total += cost[c - 1] - cost[c]
    return spans


class Scanner:
    def __init__(self, classes: Sequence[EntropyClass] = CLASSES, allow_patterns: Sequence[str] = ALLOW_PATTERNS,
                 allow_strings: Sequence[str] = ()):
        self.classes = [(c, re.compile(c.run.encode()), [re.compile(n.encode()) for n in c.needs]) for c in classes]
        self.allow = [re.compile(p.encode()) for p in allow_patterns]
        self.known = {s.encode() for s in allow_strings}
        self.kinds = [*BASE_KINDS, *(f"entropy_{c.name}" for c in classes)]

    def _base(self, data: bytes) -> Iterator[tuple[int, int, int]]:
        low = data.lower()
        if any(name in low for name in _NAMES):
            yield from ((*m.span(), 0) for m in _ASSIGN.finditer(data) if len(m[1]) >= 8)
        if b"AKIA" in data:
            yield from ((*m.span(), 1) for m in _ACCESS.finditer(data) if len(m[0]) >= 16)
        if b"x" * 32 in data.translate(_HEX_MARKS):
            yield from ((*m.span(), 2) for m in _HEX.finditer(data))

    def _entropy(self, data: bytes) -> Iterator[tuple[int, int, int]]:
        if b"x" * MIN_CANDIDATE not in data.translate(_TOKEN_MARKS):
            return
        for found in _CANDIDATE.finditer(data):
            if found[0] in self.known:
                continue
            for at, part in self._open_parts(found):
                yield from self._high(at, part)

    def _open_parts(self, found: re.Match[bytes]) -> Iterator[tuple[int, bytes]]:
        """(place, bytes) of a candidate without what the allow-list matches and the letters and digits that belong to it."""
        word, at = found[0], 0
        for a, b in sorted(m.span() for p in self.allow for m in p.finditer(word)):
            if b < at:
                continue
            while a > at and word[a - 1] in _ALNUM:
                a -= 1
            if a > at:
                yield found.start() + at, word[at:a]
            at = max(at, _REST.match(word, b).end())
        if at < len(word):
            yield found.start() + at, word[at:]

    def _high(self, at: int, part: bytes) -> Iterator[tuple[int, int, int]]:
        for k, (kind, runs, needs) in enumerate(self.classes):
            for run in runs.finditer(part):
                fit = kind.fitting(len(run[0]))
                if fit is None or not all(n.search(run[0]) for n in needs):
                    continue
                for a, b in high_windows(run[0], *fit):
                    if all(n.search(run[0], a, b) for n in needs):
                        yield at + run.start() + a, at + run.start() + b, len(BASE_KINDS) + k

    def scan(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) by start, then kind as listed, then end; in code points."""
        data = text.encode()
        spans = sorted((a, k, b) for a, b, k in [*self._base(data), *self._entropy(data)])
        if spans and not text.isascii():
            point = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
            spans = [(int(point[a]) - 1, k, int(point[b - 1])) for a, k, b in spans]  # ASCII at both ends
        return [(self.kinds[k], a, b) for a, k, b in spans]


def secret_spans(text: Column, classes: Sequence[EntropyClass] = CLASSES, allow_patterns: Sequence[str] = ALLOW_PATTERNS,
                 allow_strings: Sequence[str] = ()) -> Column:
    """array<struct<kind: string, start: bigint, end: bigint>> of a text column."""

    @F.arrow_udf("array<struct<kind:string,start:bigint,end:bigint>>")
    @releasing
    def scanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner(classes, allow_patterns, allow_strings)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for texts in batches:
            yield pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in scanner.scan(t.as_py() or "")]
                            for t in texts], kind)

    return scanned(text)
