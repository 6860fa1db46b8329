"""Removal of long repeated byte strings by suffix arrays of shards.

Every string of LENGTH bytes belongs to the smallest hash among its GRAM-byte runs (the rightmost of equals), its anchor. Equal
strings have equal anchors, so the strings of a text fall into segments, one an anchor occurrence, and repeats are found among the
segments of one anchor. Equal segments of a text are one row with all their starts. Anchors that occur once are left out, equal segments are counted as one, and the distinct
segments of the others are dealt by anchor into shards. A shard's suffix array is built by induced sorting; a
string repeats where the permuted common prefix reaches LENGTH. An anchor with more than HOT distinct segments is split by
content instead: blocks of strings that share a core, then single strings, both counted with pre-aggregation.

Passages of a number of whole words are found in the same way from word anchors, and the windows of segments with equal anchors are counted.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltlake.llm.common import small_batches, tasks, written
from voltlake.llm.suffix_array import plcp, suffix_array
from voltlake.llm.textops import BASE, PIECE, U, gram_hashes, mixed, spans, table, word_hashes

LENGTH = 400
GRAM = 64
HOT = 512
BLOCK = 16
SHARD = 1 << 20  # bytes of text sorted at once; one anchor's segments may add up to HOT * 2 * LENGTH more
PARTS = 8
GRAM_WORDS = 8
_END = 0xFF  # occurs in no UTF-8 text
_SPACE = table(b" \t\n\r\x0b\x0c")


def row_key() -> Column:
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce("text", F.lit("")))))).alias("rid")


def _dealt(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the strings of ``width`` grams with hashes ``h``: (first, number, place of the least gram, the rightmost of equals) of each run that shares it."""
    m = len(h)
    value = (h & U(0xFFFFFFFF00000000)) | (U(0xFFFFFFFF) - np.arange(m).astype(U))
    padded = np.full(-(-m // width) * width, U(0xFFFFFFFFFFFFFFFF), dtype=U)
    padded[:m] = value
    rows = padded.reshape(-1, width)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = m - width + 1
    low = np.minimum(right[:starts], left[width - 1: width - 1 + starts])
    place = (U(0xFFFFFFFF) - (low & U(0xFFFFFFFF))).astype(np.int64)
    edge = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    return edge, np.diff(np.append(edge, starts)), place[edge]


def segments(buf: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first start, number of starts, place of the anchor, hash of the anchor) of every segment, in order."""
    out = []
    for at in range(0, len(buf) - length + 1, PIECE):
        part = buf[at: at + PIECE + length - 1]
        h = gram_hashes(part, gram)
        first, count, place = _dealt(h, length - gram + 1)
        out.append((first + at, count, place + at, h[place].view(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


_PART = "h long, seg binary, s int, more array<int>, m int, anchor int"


def _once_a_text(own: np.ndarray, keys: tuple[np.ndarray, ...], s: np.ndarray) -> tuple:
    """Of segments in order, those of text ``own`` equal where ``keys`` are: which are the first of their kind in the text, and the starts ``s`` of the further ones (null: none)."""
    import pyarrow as pa

    order = np.lexsort((*keys, own))  # stable
    differ = np.zeros(max(0, len(own) - 1), dtype=bool)
    for x in (own, *keys):
        differ |= x[order[1:]] != x[order[:-1]]
    head = np.flatnonzero(np.append(True, differ)) if len(own) else order
    kind = np.empty(len(own), dtype=np.int64)
    kind[order] = np.repeat(order[head], np.diff(np.append(head, len(own))))
    new = kind == np.arange(len(own))
    rest = np.flatnonzero(~new)
    rest = rest[np.argsort(kind[rest], kind="stable")]
    n = np.bincount(kind[rest], minlength=len(own))[new]
    ends = pa.array(np.append(0, np.cumsum(n)).astype(np.int32))
    return np.flatnonzero(new), pa.ListArray.from_arrays(ends, pa.array(s[rest].astype(np.int32)), mask=pa.array(n == 0))


def _occurrences() -> Column:
    return F.sum(F.lit(1) + F.coalesce(F.array_size("more"), F.lit(0))).alias("n")


def _anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(rid, h, seg, s, more, m, anchor): hash of the anchor and of the segment, first start, further starts of equal segments in the text (null: none),
    number of strings, place of the anchor."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        empty = np.empty(0, dtype=np.int64)
        for rows in batches:
            own, found, seg = [], [], []
            for k, text in enumerate(rows.column("text").to_pylist()):
                data = (text or "").encode()
                if len(data) < length:
                    continue
                found.append(segments(np.frombuffer(data, dtype=np.uint8), length, gram))
                first, count = found[-1][:2]
                own.append(np.full(len(first), k))
                seg += [xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(first.tolist(), (first + count + (length - 1)).tolist(), strict=True)]
            s, m, anchor, h = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (empty,) * 4
            own = np.concatenate(own) if own else empty
            new, more = _once_a_text(own, tuple(np.frombuffer(b"".join(seg), dtype=np.int64).reshape(-1, 2).T), s)
            yield pa.RecordBatch.from_arrays(
                [rows.column("rid").take(pa.array(own[new])), pa.array(h[new]), pa.array(seg, pa.binary()).take(pa.array(new)), pa.array(s[new].astype(np.int32)), more,
                 *(pa.array(x[new].astype(np.int32)) for x in (m, anchor))],
                ["rid", "h", "seg", "s", "more", "m", "anchor"])

    return docs.select(row_key(), "text").mapInArrow(run, "rid binary, " + _PART)


def _cut_out(texts: DataFrame) -> DataFrame:
    """Of rows (rid, text, wanted) the wanted segments with their bytes: (h, seg, once, m, anchor, body)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        for rows in batches:
            data = [(text or "").encode() for text in rows.column("text").to_pylist()]
            wanted = rows.column("wanted")
            own = np.repeat(np.arange(rows.num_rows), wanted.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            first, count, more = (wanted.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("s", "m", "more"))
            body = [data[k][a:b] for k, a, b in zip(own.tolist(), first.tolist(), (first + count + more).tolist(), strict=True)]
            # the row is found by a hash of its key: what does not fit is another row
            fits = pa.array([xxhash.xxh3_128_digest(x) == seg for x, seg in zip(body, wanted.flatten().field("seg").to_pylist(), strict=True)], pa.bool_())
            out = pa.RecordBatch.from_arrays([*(wanted.flatten().field(c) for c in ("h", "seg", "once", "m", "anchor")), pa.array(body, pa.binary())],
                                             ["h", "seg", "once", "m", "anchor", "body"])
            yield out.filter(fits)

    return texts.mapInArrow(run, "h long, seg binary, once boolean, m int, anchor int, body binary")


def shared(kinds: list[tuple[bytes, int]], length: int, gram: int, parts: int = PARTS) -> list[tuple[int, int]]:
    """Of each of an anchor's distinct segments (bytes, place of the anchor) the stretch that can hold strings of another one; (0, 0) if there is none.

    Equal strings start as far before the anchor as each other. All that start within one of ``parts`` ranges of distances have some bytes
    in common, and where no other segment has these bytes, none of the strings occurs again.
    """
    parts = max(1, min(parts, length - gram))
    cuts = [(length - gram) * k // parts for k in range(parts + 1)]
    cores = []
    for body, anchor in kinds:
        own = []
        for k in range(parts):
            a, b = anchor - cuts[k], anchor - cuts[k + 1] + length
            own.append(body[a:b] if a >= 0 and b <= len(body) else None)  # a segment that has such a string has these bytes
        cores.append(own)
    seen = Counter((k, core) for own in cores for k, core in enumerate(own) if core is not None)
    out = []
    for (body, anchor), own in zip(kinds, cores, strict=True):
        some = [k for k, core in enumerate(own) if core is not None and seen[k, core] > 1]
        out.append((max(0, anchor - cuts[some[-1] + 1]), min(len(body), anchor - cuts[some[0]] + length)) if some else (0, 0))
    return out


def repeated_starts(bodies: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """Of each segment the runs [a, b) of starts whose string occurs again in the shard."""
    raw = b"".join(b + bytes([_END]) for b in bodies)
    u = np.frombuffer(raw, dtype=np.uint8)
    t = np.append(u.astype(np.int32) + 1, 0).astype(np.int32)
    size = np.array([len(b) + 1 for b in bodies])
    ends = np.cumsum(size)
    room = np.append(np.repeat(ends - 1, size) - np.arange(len(u)), 0)
    phi, common = plcp(raw + b"\0", suffix_array(t), room)
    again = np.flatnonzero(common >= length)
    hit = np.zeros(len(t), dtype=bool)
    hit[again] = True
    hit[phi[again]] = True
    first, last = spans(hit)
    owner = np.searchsorted(ends, first, side="right")
    out: list[list[tuple[int, int]]] = [[] for _ in bodies]
    for a, b, k in zip(first.tolist(), last.tolist(), owner.tolist(), strict=True):
        begin = int(ends[k] - size[k])
        out[k].append((a - begin, b - begin))
    return out


_RUNS = "h long, seg binary, runs array<struct<a:int,b:int>>"


def _by_shards(parts: DataFrame, length: int, gram: int) -> DataFrame:
    """Repeated starts of segments that occur once and whose anchors are not hot. Of an anchor's segments only what may occur in another one is sorted."""

    def flush(held: list):
        import pyarrow as pa

        runs = repeated_starts([x[2] for x in held], length)
        some = [(x[0], x[1], [{"a": a + x[4], "b": b + x[4]} for a, b in r]) for x, r in zip(held, runs, strict=True) if r and x[3]]
        made = list(zip(*some, strict=True)) or [[]] * 3
        kinds = [pa.int64(), pa.binary(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(made, kinds, strict=True)], ["h", "seg", "runs"])

    def run(batches: Iterator) -> Iterator:
        group, held, size = [], [], 0

        def chosen() -> int:
            """Moves the group's candidates to the shard; bytes added."""
            added = 0
            for (h, seg, once, _, body), (a, b) in zip(group, shared([(x[4], x[3]) for x in group], length, gram), strict=True):
                if a < b:
                    held.append((h, seg, body[a:b], once, a))
                    added += b - a + 1
            group.clear()
            return added

        for rows in batches:
            for row in zip(*(rows.column(c).to_pylist() for c in ("h", "seg", "once", "anchor", "body")), strict=True):
                if group and row[0] != group[0][0]:
                    size += chosen()
                    if size >= SHARD:
                        yield flush(held)
                        held, size = [], 0
                group.append(row)
        chosen()
        if held:
            yield flush(held)

    spread = parts.select("h", "seg", "once", "anchor", "body").repartition(tasks(parts.sparkSession), "h").sortWithinPartitions("h")
    return spread.mapInArrow(run, _RUNS)


def _by_content(parts: DataFrame, length: int, block: int) -> DataFrame:
    """Repeated starts of segments that occur once and have hot anchors, one row a segment.

    Strings are grouped by how far before the anchor they start, ``block`` distances at a time. Equal strings of a group
    share the bytes that all its strings have in common, the core. Groups in which only one text occurs are decided by its count; of the
    others every string is counted.
    """

    def blocks(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        for rows in batches:
            out = []
            for h, seg, once, m, anchor, body in zip(*(rows.column(c).to_pylist() for c in ("h", "seg", "once", "m", "anchor", "body")), strict=True):
                for q in range((anchor - m + 1) // block, anchor // block + 1):
                    a, b = max(0, anchor - q * block - block + 1), min(m, anchor - q * block + 1)
                    if a < b:
                        core = body[max(0, anchor - q * block): anchor - q * block - block + 1 + length]
                        out.append((h, seg, once, q, a, b, xxhash.xxh3_128_digest(core), xxhash.xxh3_128_digest(body[a: b - 1 + length] + bytes([b - a]))))
            made = list(zip(*out, strict=True)) or [[]] * 8
            kinds = [pa.int64(), pa.binary(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(made, kinds, strict=True)], ["h", "seg", "once", "q", "a", "b", "core", "own"])

    def strings(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        for rows in batches:
            out = []
            for h, seg, once, a, b, body in zip(*(rows.column(c).to_pylist() for c in ("h", "seg", "once", "a", "b", "body")), strict=True):
                out += [(h, seg, once, i, xxhash.xxh3_128_digest(body[i: i + length])) for i in range(a, b)]
            made = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.binary(), pa.bool_(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(made, kinds, strict=True)], ["h", "seg", "once", "i", "own"])

    cut = written(parts.mapInArrow(blocks, "h long, seg binary, once boolean, q int, a int, b int, core binary, own binary"), "blocks")
    kinds = cut.groupBy("h", "q", "core", "own").agg(F.count("*").alias("n"))
    groups = kinds.groupBy("h", "q", "core").agg(F.count("*").alias("kinds"), F.max("n").alias("most"))
    some = cut.join(groups.filter("kinds > 1 or most > 1"), ["h", "q", "core"])
    whole = some.filter("kinds = 1 and once").select("h", "seg", F.array(F.struct("a", "b")).alias("runs"))
    single = some.filter("kinds > 1").select("h", "seg", "once", "a", "b").join(parts.select("h", "seg", "body"), ["h", "seg"]).mapInArrow(strings, "h long, seg binary, once boolean, i int, own binary")
    single = written(single, "strings")
    twice = single.groupBy("own").agg(F.count("*").alias("n")).filter("n > 1").select("own")
    hits = single.filter("once").join(twice, "own").groupBy("h", "seg").agg(F.transform(F.collect_list("i"), lambda i: F.struct(i.alias("a"), (i + 1).alias("b"))).alias("runs"))
    return whole.union(hits).groupBy("h", "seg").agg(F.flatten(F.collect_list("runs")).alias("runs"))


class _Words:
    """The words of a batch of texts: hashes of words, of words with what stands behind them, and of runs of ``gram`` words."""

    def __init__(self, texts: list, words: int):
        self.words, self.gram = words, min(GRAM_WORDS, words)
        data = [(t or "").encode() for t in texts]
        buf = np.frombuffer(b"\n".join(data), dtype=np.uint8)  # all texts at once; no string below reaches over a separator
        starts, ends = spans(~_SPACE[buf])
        self.word = word_hashes(buf, starts, ends)
        behind = np.append(starts[1:], len(buf))
        gap = buf[np.minimum(ends, len(buf) - 1)].astype(U) if len(buf) else self.word
        wide = np.flatnonzero(behind - ends > 1)  # mostly one space stands between words
        gap[wide] = word_hashes(buf, ends[wide], behind[wide])
        self.apart = mixed(self.word * BASE + gap)
        at = np.arange(max(0, len(starts) - self.gram + 1))
        self.grams = word_hashes(self.word, at, at + self.gram)
        self.bounds = np.searchsorted(starts, np.append(0, np.cumsum([len(d) + 1 for d in data]))).tolist()

    def hashes(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hash of the bytes from the first to the last word."""
        return mixed(word_hashes(self.apart, first, last) * BASE + self.word[last])

    def segments(self):
        """(text, first word, number of strings, hash of the anchor) of every segment, words counted over the batch."""
        own, out, width = [], [], self.words - self.gram + 1
        for k, (lo, hi) in enumerate(zip(self.bounds, self.bounds[1:])):
            for at in range(lo, hi - self.words + 1, PIECE):
                first, count, place = _dealt(self.grams[at: min(at + PIECE + width - 1, hi - self.gram + 1)], width)
                own.append(np.full(len(first), k))
                out.append((first + at, count, self.grams[at + place].view(np.int64)))
        empty = np.empty(0, dtype=np.int64)
        return (np.concatenate(own) if own else empty, *((np.concatenate(x) for x in zip(*out)) if out else (empty,) * 3))


def _word_anchors(docs: DataFrame, words: int) -> DataFrame:
    """(rid, h, seg, s, more, m): as ``_anchors`` for strings of ``words`` whole words; s, more and m count words."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for rows in batches:
            w = _Words(rows.column("text").to_pylist(), words)
            own, first, count, h = w.segments()
            seg = w.hashes(first, first + count + (words - 2)).view(np.int64) if len(own) else h
            s = first - np.array(w.bounds)[own]
            new, more = _once_a_text(own, (h, seg), s)
            yield pa.RecordBatch.from_arrays(
                [rows.column("rid").take(pa.array(own[new])), pa.array(h[new]), pa.array(seg[new]), pa.array(s[new].astype(np.int32)), more, pa.array(count[new].astype(np.int32))],
                ["rid", "h", "seg", "s", "more", "m"])

    return docs.select(row_key(), "text").mapInArrow(run, "rid binary, h long, seg long, s int, more array<int>, m int")


def _windows(texts: DataFrame, words: int) -> DataFrame:
    """Of rows (text, windows) every string of ``words`` words of the wanted segments: (h, seg, i, n, r0, r1, own)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for rows in batches:
            w = _Words(rows.column("text").to_pylist(), words)
            wanted = rows.column("windows")
            own = np.repeat(np.arange(rows.num_rows), wanted.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            h, seg, s, m, n, r0, r1 = (x.to_numpy(zero_copy_only=False) for x in wanted.flatten().flatten())
            first = np.array(w.bounds)[own] + s
            order = np.argsort(first, kind="stable")  # as the hashes want them
            own, h, seg, m, n, r0, r1, first = (x[order] for x in (own, h, seg, m, n, r0, r1, first))
            # the row is found by a hash of its key: what does not fit is another row
            fits = np.flatnonzero(first + m + (words - 1) <= np.array(w.bounds)[own + 1])
            fits = fits[w.hashes(first[fits], first[fits] + m[fits] + (words - 2)).view(np.int64) == seg[fits]] if len(fits) else fits
            at = np.repeat(fits, m[fits])
            i = np.arange(len(at)) - np.repeat(np.cumsum(m[fits]) - m[fits], m[fits])
            start = first[at] + i
            order = np.argsort(start, kind="stable")
            at, i, start = at[order], i[order], start[order]
            made = w.hashes(start, start + (words - 1)).view(np.int64) if len(at) else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h[at]), pa.array(seg[at]), pa.array(i.astype(np.int32)), pa.array(n[at]), pa.array(r0[at]), pa.array(r1[at]), pa.array(made)],
                                             ["h", "seg", "i", "n", "r0", "r1", "own"])

    return texts.mapInArrow(run, "h long, seg long, i int, n long, r0 long, r1 long, own long")


def spans_of(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, block: int = BLOCK, words: int = 0, elsewhere: bool = False) -> DataFrame:
    """(rid, text, starts, passages): of every row with a repeated string its text, the runs of starts of such strings, and, if ``words`` is set, the runs of first words of
    strings of ``words`` words that occur again (with ``elsewhere``: in another row); rows that repeat id and text are one."""
    docs = docs.select("doc_id", "text")
    anchors = written(_anchors(docs, length, gram), "anchors")
    # counts are written tables, so that the joins below read plain shuffles, of which hot partitions can be split
    often = written(anchors.groupBy("h").agg(_occurrences()).filter("n > 1").select("h"), "often")
    seen = written(anchors.join(often, "h"), "repeated")
    # equal segments have their anchor at the same place; the values have fixed width, so that they are hashed, not sorted
    r = F.xxhash64("rid")
    one = (F.min(r).alias("r"), F.min_by("s", r).alias("s"), F.max("m").alias("m"), F.max(F.col("anchor") - F.col("s")).alias("anchor"))
    kinds = written(seen.groupBy("h", "seg").agg(_occurrences(), *one), "kinds")
    size = written(kinds.groupBy("h").agg(F.count("*").alias("kinds")), "kinds-of-anchor")
    many = kinds.join(size, "h")
    # bytes are needed of one occurrence of every segment whose anchor has several
    wanted = many.filter("kinds > 1").select(F.col("r").alias("has"), F.struct("h", "seg", (F.col("n") == 1).alias("once"), "s", "m", "anchor", F.lit(length - 1).alias("more")).alias("w"))
    rids = seen.select("rid")
    if words:
        word_anchors = written(_word_anchors(docs, words), "word-anchors")
        again = "r0 != r1" if elsewhere else "n > 1"
        counted = (_occurrences(), F.min(r).alias("r0"), F.max(r).alias("r1"))
        often = written(word_anchors.groupBy("h").agg(*(counted[1:] if elsewhere else counted[:1])).filter(again).select("h"), "often-words")
        word_seen = written(word_anchors.join(often, "h"), "repeated-words")
        place = F.min_by(F.shiftleft(F.col("s").cast("long"), 32).bitwiseOR(F.col("m").cast("long")), r).alias("place")
        word_kinds = written(word_seen.groupBy("h", "seg").agg(*counted, place), "word-kinds")
        several = written(word_kinds.groupBy("h").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("h"), "several-words")
        s, m = F.shiftright("place", 32).cast("int").alias("s"), F.col("place").bitwiseAND((1 << 32) - 1).cast("int").alias("m")
        windows = word_kinds.join(several, "h").groupBy("r0").agg(F.collect_list(F.struct("h", "seg", s, m, "n", "r0", "r1")).alias("windows")).withColumnRenamed("r0", "of")
        rids = rids.union(word_seen.select("rid"))
    wanted = wanted.groupBy("has").agg(F.collect_list("w").alias("wanted"))
    needed = rids.distinct().withColumn("r", r).join(wanted, F.col("r") == F.col("has"), "left")
    if words:
        needed = needed.join(windows, F.col("r") == F.col("of"), "left").drop("of")
    needed = needed.drop("r", "has").withColumnRenamed("rid", "need")
    own = docs.select(row_key(), "text")
    held = written(own.join(needed, F.col("rid") == F.col("need")).drop("need").dropDuplicates(["rid"]), "held")
    parts = written(_cut_out(held.select("text", "wanted").filter("wanted is not null")), "segments")
    parts = parts.join(size, "h")
    found = _by_shards(parts.filter(F.col("kinds") <= hot), length, gram)
    if not size.filter(F.col("kinds") > hot).isEmpty():
        found = found.union(_by_content(parts.filter(F.col("kinds") > hot), length, block))
    # a segment that occurs several times is repeated as a whole and has this row alone, so that its copies meet one
    copied = many.filter("n > 1").select("h", "seg", F.array(F.struct(F.lit(0).alias("a"), F.col("m").alias("b"))).alias("runs"))
    found = written(found.union(copied), "found")
    out = held.select("rid", "text").join(_runs(seen, found).withColumnsRenamed({"rid": "at", "runs": "starts"}), F.col("rid") == F.col("at"), "left").drop("at")
    if not words:
        return out.filter("starts is not null").withColumn("passages", F.lit(None).cast("array<struct<a:int,b:int>>"))
    each = written(_windows(held.select("text", "windows").filter("windows is not null"), words), "windows")
    # equal strings have equal anchors, so both hashes together name one
    twice = written(each.groupBy("h", "own").agg(*([F.min("r0").alias("r0"), F.max("r1").alias("r1")] if elsewhere else [F.sum("n").alias("n")])).filter(again).select("h", "own"), "windows-twice")
    hits = each.filter(f"not ({again})").join(twice, ["h", "own"]).groupBy("h", "seg").agg(F.transform(F.array_sort(F.collect_set("i")), lambda i: F.struct(i.alias("a"), (i + 1).alias("b"))).alias("runs"))
    copied = word_kinds.filter(again).select("h", "seg", F.array(F.struct(F.lit(0).alias("a"), m.alias("b"))).alias("runs"))
    passages = _runs(word_seen, written(hits.union(copied), "found-words"))
    out = out.join(passages.withColumnsRenamed({"rid": "at", "runs": "passages"}), F.col("rid") == F.col("at"), "left")
    return out.drop("at").filter("starts is not null or passages is not null")


def _runs(seen: DataFrame, found: DataFrame) -> DataFrame:
    """(rid, runs): what was found of each segment, moved to where it stands in every row."""
    starts = F.concat(F.array("s"), F.coalesce("more", F.array().cast("array<int>")))
    moved = F.transform(starts, lambda s: F.transform("runs", lambda r: F.struct((r["a"] + s).alias("a"), (r["b"] + s).alias("b"))))
    return seen.select("rid", "h", "seg", "s", "more").join(found, ["h", "seg"]).groupBy("rid").agg(F.flatten(F.collect_list(F.flatten(moved))).alias("runs"))


def _bounds(runs) -> list[tuple[np.ndarray, np.ndarray]]:
    """Starts and ends of the runs of every row of an Arrow column of lists; a null is an empty list."""
    ends = np.cumsum(runs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
    a, b = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in runs.flatten().flatten())
    return [(a[lo:hi], b[lo:hi]) for lo, hi in zip([0, *ends], ends)]


def covered(a: np.ndarray, b: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the maximal runs of bytes that strings with starts in [a, b) cover."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order] + length - 1)
    head = np.flatnonzero(np.append(True, a[1:] > b[:-1]))
    return a[head], b[np.append(head[1:] - 1, len(b) - 1)]


def _removed(rows: DataFrame, length: int, words: int = 0, cut: bool = False) -> DataFrame:
    """(rid, n_removed, n_spans, kept_sha256, n_passage_words, clean_text): clean_text leaves characters whole that a run only touches, and without passages too if ``cut``."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part in batches:
            out = []
            for text, starts, passages in zip(part.column("text").to_pylist(), _bounds(part.column("starts")), _bounds(part.column("passages")), strict=True):
                data = (text or "").encode()
                u = np.frombuffer(data, dtype=np.uint8)
                keep, whole = np.ones(len(u), dtype=bool), np.ones(len(u), dtype=bool)
                first, last = covered(*starts, length) if len(starts[0]) else starts
                for a, b in zip(first.tolist(), last.tolist(), strict=True):
                    keep[a:b] = False
                    while a < b and u[a] & 0xC0 == 0x80:
                        a += 1
                    while b < len(u) and b > a and u[b] & 0xC0 == 0x80:
                        b -= 1
                    whole[a:b] = False
                n = 0
                if len(passages[0]):
                    from_, to = covered(*passages, words)
                    n = int((to - from_).sum())
                    if cut:
                        begin, end = spans(~_SPACE[u])
                        for a, b in zip(begin[from_].tolist(), end[to - 1].tolist(), strict=True):
                            whole[a:b] = False
                out.append((int((~keep).sum()), len(first), hashlib.sha256(u[keep].tobytes()).hexdigest(), n, u[whole].tobytes().decode()))
            made = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([part.column("rid")] + [pa.array(x, k) for x, k in zip(made, kinds, strict=True)], ["rid", "n_removed", "n_spans", "kept_sha256", "n_passage_words", "clean_text"])

    return rows.mapInArrow(run, "rid binary, n_removed long, n_spans long, kept_sha256 string, n_passage_words long, clean_text string")


def repeats(docs: DataFrame, length: int = LENGTH, texts: bool = False, words: int = 0, **options) -> DataFrame:
    """(doc_id, rid, n_bytes, n_removed, n_spans, kept_sha256, n_passage_words[, clean_text]) of every row.

    A null text is empty; texts below ``length`` bytes have nothing to remove. Rows that repeat id and text count as separate
    occurrences and have equal results. n_passage_words counts the words inside strings of ``words`` words that occur in another row as well (0 without ``words``); it has no part
    in what is removed. clean_text is null where nothing is found. An empty table gives none. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    hit = _removed(spans_of(docs, length, words=words, elsewhere=True, **options), length, words)
    hit = hit if texts else hit.drop("clean_text")
    body = F.coalesce("text", F.lit(""))
    all_ = docs.select("doc_id", row_key(), F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("own"))
    out = all_.join(hit.withColumnRenamed("rid", "hit"), F.col("rid") == F.col("hit"), "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_removed", "n_spans", "n_passage_words")}
    return out.select("doc_id", "rid", "n_bytes", zero["n_removed"], zero["n_spans"], F.coalesce("kept_sha256", "own").alias("kept_sha256"), zero["n_passage_words"], *(["clean_text"] if texts else []))


def without_repeats(docs: DataFrame, length: int = LENGTH, words: int = 0, **options) -> DataFrame:
    """The rows of ``docs`` with repeated strings cut out of their texts; rows of which nothing is left go.

    With ``words``, repeated passages of at least so many whole words are cut as well, in however few bytes.
    """
    found = spans_of(docs.select("doc_id", "text"), length, words=words, **options)
    hit = written(_removed(found, length, words, cut=True).select("rid", "clean_text"), "clean")
    keyed = docs.withColumn("_vl_rid", row_key())
    joined = keyed.join(hit.withColumnsRenamed({"rid": "_vl_hit", "clean_text": "_vl_clean"}), F.col("_vl_rid") == F.col("_vl_hit"), "left")
    kept = joined.filter("_vl_hit is null or trim(_vl_clean) != ''").withColumn("text", F.coalesce("_vl_clean", "text"))
    return kept.select(*docs.columns)
