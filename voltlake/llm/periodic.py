"""Runs of periodic words, caught online by dyadic square catchers.

Words are appended to a stream. For every power of two B, each completed block of B words has a catcher that watches for the block to
come again 2^k to 2^(k+1) - 1 words later. An appended word ends one suffix of B words for each B, and that suffix is compared with the one
block whose catcher it concerns: equal names (hashes built by doubling) are a hit at period q = distance. Two hits of neighbouring blocks at one q are a square,
which is compared word by word to both sides and so becomes a run that later words extend. A stretch of period q that repeats four times
holds two such blocks at least, and one inside a run of a smaller period has no period of its own (periodicity lemma), so its hits are left out.
Work is O(log n) vector operations a piece and memory linear in the text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame

from voltlake.llm.common import small_batches
from voltlake.llm.textops import BASE, U, mixed

TIMES = 4
LEAST = 6
PIECE_WORDS = 1 << 17


class SquareCatcher:
    """One stream of word numbers. ``runs`` holds (start, end, period) of maximal stretches with at least two repetitions of their smallest period."""

    def __init__(self):
        self.words, self.n = np.empty(1 << 10, dtype=np.int64), 0
        self.names: list[tuple[int, np.ndarray]] = []  # by level: place of the first name, names of the 2^level words from each place on
        self.runs: list[list[int]] = []
        self.last: dict[int, list[int]] = {}  # of a period: its last run
        self.open: dict[int, list[int]] = {}  # of a period: the run that reaches the last word

    def append(self, words: np.ndarray, longest: int) -> None:
        """Add words; ``longest`` bounds the periods to look for from here on."""
        old, self.n = self.n, self.n + len(words)
        if self.n > len(self.words):
            more = np.empty(max(self.n, 2 * len(self.words)), dtype=np.int64)
            more[:old] = self.words[:old]
            self.words = more
        self.words[old: self.n] = words
        for q, run in list(self.open.items()):
            run[1] = self._right(run[1], q)
            if run[1] < self.n:
                del self.open[q]
        for level in range(max(0, longest).bit_length()):
            self._name(level, old)
            self._catch(level, old)

    def _name(self, level: int, old: int) -> None:
        """Names of the suffixes that the new words complete; names too old for any comparison go."""
        size = 1 << level
        if level == len(self.names):
            self.names.append((max(0, old - size + 1), np.empty(0, dtype=U)))
        off, have = self.names[level]
        at, stop = off + len(have), max(0, self.n - size + 1)
        if level == 0:
            at = max(at, old)
            new = mixed(self.words[at:stop].astype(U))
        else:
            low_off, low = self.names[level - 1]
            at, half = max(at, low_off), size // 2
            new = mixed(low[at - low_off: max(at, stop) - low_off] * BASE + low[at - low_off + half: max(at, stop) - low_off + half])
        if at > off + len(have):  # not looked at before: the words there were too few for this level
            off, have = at, have[:0]
        keep = min(max(off, old - 5 * size), off + len(have))
        self.names[level] = (keep, np.concatenate([have[keep - off:], new]))

    def _catch(self, level: int, old: int) -> None:
        size = 1 << level
        off, names = self.names[level]
        first = max((-(-off // size) + 1) * size, (old - 3 * size) // size * size)
        if first >= off + len(names):
            return
        mine = names[first - off:]
        blocks = np.repeat(names[first - size - off:: size], size)[: len(mine)]
        s = np.flatnonzero(mine == blocks) + first
        if len(s) < 2:
            return
        b = s // size * size - size
        q = s - b
        smaller = sorted(r for r in self.runs if r[2] < size)
        if smaller:
            start, end = np.array([r[0] for r in smaller]), np.maximum.accumulate([r[1] for r in smaller])
            at = np.searchsorted(start, b, side="right")
            free = (at == 0) | (end[at - 1] < s + size)
            b, q = b[free], q[free]
        order = np.lexsort((b, q))
        b, q = b[order], q[order]
        pair = (q[1:] == q[:-1]) & (b[1:] - b[:-1] == size)
        for i in np.flatnonzero(pair & ~np.append(False, pair[:-1])).tolist():
            self._found(int(b[i]), int(q[i]), size)

    def _found(self, b: int, q: int, size: int) -> None:
        known = self.last.get(q)
        if known and known[0] <= b and b + q + size <= known[1]:
            return
        start, end = self._left(b, q), self._right(b + q, q)
        if end - start < 2 * q:
            return  # names agreed, words did not
        run = [start, end, q]
        self.runs.append(run)
        self.last[q] = run
        if end == self.n:
            self.open[q] = run

    def _right(self, i: int, q: int) -> int:
        """The first place from i on whose word differs from the one q before it."""
        step = 64
        while i < self.n:
            to = min(self.n, i + step)
            other = np.flatnonzero(self.words[i:to] != self.words[i - q: to - q])
            if len(other):
                return i + int(other[0])
            i, step = to, 2 * step
        return i

    def _left(self, i: int, q: int) -> int:
        """The first place from which on all words up to i equal the one q after them."""
        step = 64
        while i > 0:
            to = max(0, i - step)
            other = np.flatnonzero(self.words[to:i] != self.words[to + q: i + q])
            if len(other):
                return to + int(other[-1]) + 1
            i, step = to, 2 * step
        return i


def runs_of(texts: list[list], times: int = TIMES, least: int = LEAST, piece: int = PIECE_WORDS) -> list[list[tuple[int, int, int]]]:
    """Of every list of words its runs (start, length, period) of length max(least, times * period) at least, by start and period.

    The lists are appended to one stream, the longest first, with a word between them that equals no other.
    """
    number: dict = {}
    ids = [np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words)) for words in texts]
    order = sorted(range(len(texts)), key=lambda k: -len(ids[k]))
    catcher, starts = SquareCatcher(), np.zeros(len(texts), dtype=np.int64)
    held, size, at = [], 0, 0

    def flush():
        nonlocal held, size
        longest = max((len(x) for x in held), default=0)
        stream = np.concatenate(held) if held else np.empty(0, dtype=np.int64)
        for k in range(0, len(stream), piece):
            catcher.append(stream[k: k + piece], longest // times)
        held, size = [], 0

    for rank, k in enumerate(order):
        if len(ids[k]) < max(least, times):
            starts[rank:] = at
            break
        if held and ((len(ids[k]) // times).bit_length() < (len(held[0]) // times).bit_length() or size > piece):
            flush()
        starts[rank] = at
        held += [ids[k], np.array([-1 - rank], dtype=np.int64)]
        size += len(ids[k]) + 1
        at += len(ids[k]) + 1
    flush()
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, end, q in catcher.runs:
        if end - start >= max(least, times * q):
            rank = int(np.searchsorted(starts, start, side="right")) - 1
            out[order[rank]].append((start - int(starts[rank]), end - start, q))
    return [sorted(set(x)) for x in out]


def repeated(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a test document: of every tenth id (by its crc32) those from some place on repeat with some period."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without what runs repeat: of each run its first period stays."""
    if not runs:
        return words
    keep = np.ones(len(words), dtype=bool)
    for start, length, q in runs:
        keep[start + q: start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


OUT = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, clean_text string"


def periodic_runs(docs: DataFrame, times: int = TIMES, least: int = LEAST, planted: bool = False, texts: bool = True) -> DataFrame:
    """doc_id, the number of runs, the run of greatest exponent, hashes of all runs and of the text without repetitions, and (if ``texts``) that text, of every row.

    Words are separated by ASCII white space. A null text, an empty one and one without words have no runs and an empty clean text; a row without runs keeps its words, joined by single spaces.
    Repeated rows and null ids are rows like all others; ties of the exponent go to the smallest start, then period. A very long text is appended in pieces. An empty table gives
    none. Other columns are ignored. With ``planted`` the words of every tenth id are first made periodic (see ``repeated``).
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.int64()] * 5 + [pa.string()] * 3
        for rows in batches:
            words = [(t or "").encode().split() for t in rows.column("text").to_pylist()]
            if planted:
                words = [repeated(d, w) for d, w in zip(rows.column("doc_id").to_pylist(), words, strict=True)]
            out = []
            for own, runs in zip(words, runs_of(words, times, least), strict=True):
                best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
                all_runs = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
                clean = b" ".join(collapsed(own, runs))
                out.append((len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(all_runs.encode()).hexdigest(),
                            hashlib.sha256(clean).hexdigest(), clean.decode() if texts else None))
            made = list(zip(*out, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id")] + [pa.array(x, k) for x, k in zip(made, kinds, strict=True)], ["doc_id", *(c.split()[0] for c in OUT.split(", "))])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + OUT)
