"""Benchmark decontamination with a generalised suffix automaton of the normalised items.

Words are runs of digits, a-z (after lowering A-Z) and bytes above 127. An item's windows are its runs of ``window``
words, or the whole item when it is shorter. The automaton is built over the words of the items; training words stream
through it while the longest matching length is tracked: a length of ``window`` means that the last ``window`` words are
a window of some item. A document word inside any occurrence is hit. Before the automaton, stretches are left out in
which no run of a few words occurs in the items at all (by hash, so nothing that matches is lost; the automaton itself
compares words). An automaton holds at most ``block_words`` words. A larger benchmark is dealt into blocks, and texts that may match are streamed through them one after the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlake.llm.common import small_batches, text_key, written
from voltlake.llm.textops import LOWER, sequences, spans, table, word_hashes

WINDOW = 10
BLOCK_WORDS = 200_000
GRAM = 3
SIEVE = 1 << 24  # flags
WORD = table(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))


def word_bounds(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of a text, and starts and ends of its words."""
    buf = LOWER[np.frombuffer((text or "").encode(), dtype=np.uint8)]
    return (buf, *spans(WORD[buf]))


def words_of(buf: np.ndarray, starts, ends) -> list[bytes]:
    raw = buf.tobytes()
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


class Automaton:
    """Suffix automaton of several word sequences, with the items of every window and of every short item."""

    def __init__(self, items: dict, window: int):
        self.window = window
        self.next: list[dict] = [{}]
        self.link, self.len = [-1], [0]
        self.ids: dict[bytes, int] = {}
        for item, words in items.items():
            self._add([self.ids.setdefault(w, len(self.ids)) for w in words])
        self.items: dict[int, set] = {}  # of a state: the items whose window ends there
        self.short: dict[int, list] = {}  # of a state: lengths and items of whole short items that are its suffixes
        ends: dict[int, list] = {}
        for item, words in items.items():
            state = length = 0
            size = min(window, len(words))
            for w in words:
                state, length = self._step(state, length, self.ids[w])
                if length >= size:
                    at = self._cut(state, size)
                    if len(words) >= window:
                        self.items.setdefault(at, set()).add(item)
                    else:
                        ends.setdefault(at, []).append((size, item))
        for s in range(len(self.next)):
            t, found = s, []
            while t > 0:
                found += ends.get(t, [])
                t = self.link[t]
            if found:
                self.short[s] = found

    def _add(self, word_ids: list[int]) -> None:
        last = 0
        for c in word_ids:
            last = self._extend(last, c)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, size = self.next, self.link, self.len
        if c in nxt[last]:
            q = nxt[last][c]
            return q if size[q] == size[last] + 1 else self._clone(last, c, q)
        cur = self._state({}, 0, size[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if size[q] == size[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        copy = self._state(dict(self.next[q]), self.link[q], self.len[p] + 1)
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _state(self, out: dict, link: int, size: int) -> int:
        self.next.append(out)
        self.link.append(link)
        self.len.append(size)
        return len(self.next) - 1

    def _cut(self, state: int, size: int) -> int:
        """The state of the suffix of ``size`` words."""
        while self.len[self.link[state]] >= size:
            state = self.link[state]
        return state

    def _step(self, state: int, length: int, c: int) -> tuple[int, int]:
        """State and length of the longest suffix that still matches after word c."""
        nxt, link = self.next, self.link
        while state and c not in nxt[state]:
            state = link[state]
            length = self.len[state]
        if c in nxt[state]:
            return nxt[state][c], length + 1
        return 0, 0

    def stream(self, words: list[bytes], hit: np.ndarray, found: set) -> None:
        """Mark the words inside occurrences in ``hit`` and add the items that occur."""
        state = length = 0
        for i, w in enumerate(words):
            c = self.ids.get(w, -1)
            state, length = self._step(state, length, c)
            if length >= self.window:
                own = self._cut(state, self.window)
                if own in self.items:
                    hit[i - self.window + 1: i + 1] = True
                    found |= self.items[own]
            for size, item in self.short.get(state, ()):
                if length >= size:
                    hit[i - size + 1: i + 1] = True
                    found.add(item)


class Matcher:
    """An automaton with the hashes of its items' runs of ``gram`` words, by which stretches without a match are left out."""

    def __init__(self, items: dict, window: int):
        self.automaton = Automaton(items, window)
        self.gram = min([GRAM, *map(len, items.values())])
        grams = [sequences(word_hashes(*_joined(w)), self.gram) for w in items.values()]
        self.grams = np.unique(np.concatenate(grams)) if grams else np.empty(0, dtype=np.uint64)
        self.sieve = np.zeros(1 << 20, dtype=bool)
        self.sieve[self.grams & np.uint64((1 << 20) - 1)] = True

    def match(self, buf, starts, ends, hashes, hit, found: set) -> None:
        grams = sequences(hashes, self.gram)
        maybe = np.flatnonzero(self.sieve[grams & np.uint64((1 << 20) - 1)])
        place = np.minimum(np.searchsorted(self.grams, grams[maybe]), len(self.grams) - 1)
        maybe = maybe[self.grams[place] == grams[maybe]]
        if not len(maybe):
            return
        inside = np.zeros(len(hashes), dtype=bool)
        for k in range(self.gram):
            inside[maybe + k] = True
        for a, b in zip(*spans(inside), strict=True):
            self.automaton.stream(words_of(buf, starts[a:b], ends[a:b]), hit[a:b], found)


def _joined(words: list[bytes]):
    buf = np.frombuffer(b" ".join(words), dtype=np.uint8)
    return (buf, *spans(WORD[buf]))


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[dict]:
    """Normalised items in blocks of at most ``block_words`` words (a longer item is a block of its own); the driver holds one block at a time."""
    block, size = {}, 0
    for item, text in benchmark.select("item_id", "text").filter("text is not null").orderBy("item_id", "text").toLocalIterator():
        words = words_of(*word_bounds(text))
        if not words:
            continue
        if size and size + len(words) > block_words:
            yield block
            block, size = {}, 0
        block[(item, hashlib.md5(text.encode()).digest())] = words  # items of one id may have several texts
        size += len(words)
    if block:
        yield block


def _sieves(blocks: Iterator[dict]) -> dict[int, np.ndarray]:
    """Flags of the hashes of the items' word runs by their length, of a fixed size."""
    out: dict[int, np.ndarray] = {}
    for block in blocks:
        gram = min([GRAM, *map(len, block.values())])
        flags = out.setdefault(gram, np.zeros(SIEVE, dtype=bool))
        for words in block.values():
            flags[sequences(word_hashes(*_joined(words)), gram) & np.uint64(SIEVE - 1)] = True
    return out


def _marked(docs: DataFrame, benchmark: DataFrame, window: int, block_words: int) -> DataFrame:
    """(tid, spans, items) of every text with hits, for a benchmark of more than one block.

    One pass over all texts keeps those with a word run that any block may have (a fixed number of flags is sent to the tasks); those few are
    written and read once for each block, of which the tasks and the driver hold one at a time.
    """
    spark = docs.sparkSession
    flags = spark.sparkContext.broadcast(_sieves(item_blocks(benchmark, block_words)))

    def sift(batches: Iterator) -> Iterator:
        for rows in batches:
            keep = []
            for text in rows.column("text").to_pylist():
                hashes = word_hashes(*word_bounds(text))
                keep.append(any(f[sequences(hashes, gram) & np.uint64(SIEVE - 1)].any() for gram, f in flags.value.items()))
            yield rows.filter(keep)

    def mark(shared):
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            matcher = Matcher(shared.value, window)
            for rows in batches:
                tid, spans_, items = [], [], []
                for key, text in zip(rows.column("tid").to_pylist(), rows.column("text").to_pylist(), strict=True):
                    _, _, hit, _, found = _hits([matcher], text)
                    if found:
                        tid.append(key)
                        spans_.append([{"a": int(a), "b": int(b)} for a, b in zip(*spans(hit), strict=True)])
                        items.append(["null" if i is None else str(i) for i in found])
                yield pa.RecordBatch.from_arrays([pa.array(tid, pa.binary()), pa.array(spans_, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), pa.array(items, pa.list_(pa.string()))],
                                                 ["tid", "spans", "items"])

        return run

    some = written(docs.select(text_key(), "text").mapInArrow(sift, "tid binary, text string").dropDuplicates(["tid"]), "may-be-hit")
    all_ = None
    for block in item_blocks(benchmark, block_words):
        shared = spark.sparkContext.broadcast(block)
        part = written(some.mapInArrow(mark(shared), "tid binary, spans array<struct<a:int,b:int>>, items array<string>"), "hits")
        shared.destroy()
        all_ = part if all_ is None else all_.union(part)
    merged = all_.groupBy("tid").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return written(merged, "marks")


def _hits(matchers: list[Matcher], text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, set]:
    buf, starts, ends = word_bounds(text)
    hit, found = np.zeros(len(starts), dtype=bool), set()
    if len(starts):
        hashes = word_hashes(buf, starts, ends)
        for m in matchers:
            m.match(buf, starts, ends, hashes, hit, found)
    return starts, ends, hit, buf, {item for item, _ in found}


COUNTS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, clean_text string, drop_document boolean"


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, max_share: float = 0.5, texts: bool = True) -> DataFrame:
    """row (a struct of the columns of ``docs``, without the text if ``texts`` is off), its counts, its text without the hit words, and whether hits cover more than
    ``max_share`` of its words.

    A null text has no words and stays null; null item ids count as one item named ``null``; an empty benchmark hits
    nothing. As the columns of ``docs`` stay in their struct, their names may clash with the counts.
    """
    small_batches(docs.sparkSession)
    blocks = item_blocks(benchmark, block_words)
    first, more = next(blocks, None), next(blocks, None)
    asked = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("row"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(first)  # at most block_words words, or one item
    if more:
        marks = _marked(docs, benchmark, window, block_words)
        asked = asked.withColumn("_own", text_key()).join(marks, F.col("_own") == F.col("tid"), "left").select("row", "text", "spans", "items")
    names = [x.split()[0] for x in COUNTS.split(", ")]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        matchers = [Matcher(shared.value, window)] if first and not more else []
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.bool_()]
        for rows in batches:
            out = []
            known = zip(rows.column("spans").to_pylist(), rows.column("items").to_pylist(), strict=True) if more else [(None, None)] * rows.num_rows
            for text, (marked, found) in zip(rows.column("text").to_pylist(), known, strict=True):
                starts, ends, hit, buf, items = _hits(matchers, text)
                for x in marked or ():
                    hit[x["a"]: x["b"]] = True
                n, n_hit = len(starts), int(hit.sum())
                ids = ",".join(sorted({"null" if i is None else str(i) for i in found or items}))
                clean = text
                if texts and n_hit:
                    keep = np.ones(len(buf), dtype=bool)
                    for a, b in zip(*spans(hit), strict=True):
                        keep[starts[a]: ends[b - 1]] = False
                    clean = np.frombuffer(text.encode(), dtype=np.uint8)[keep].tobytes().decode()
                out.append((n, n_hit, len(found or items), hashlib.sha256(ids.encode()).hexdigest(), n_hit > 0, clean if texts else None, n_hit > max_share * n))
            made = list(zip(*out, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([rows.column("row")] + [pa.array(x, k) for x, k in zip(made, kinds, strict=True)], ["row", *names])

    return asked.mapInArrow(run, f"row {asked.schema['row'].dataType.simpleString()}, {COUNTS}")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The columns of ``docs`` with hit words cut out of the texts; documents that consist mostly of them go."""
    found = decontaminate(docs, benchmark, **options).filter("not drop_document")
    return found.select(*[F.col("clean_text").alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
