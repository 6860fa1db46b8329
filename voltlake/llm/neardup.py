"""Near-duplicate documents by a chosen-path set similarity join.

A document's set holds its distinct five-word shingles; equal sets are one class. Every class is embedded by COORDINATES
minwise tokens. In each of TREES independent trees a class starts at the root and follows two branches a level: the node
chooses two coordinates, and a branch is named by the token there. Nodes of at most LEAF classes are compared
exhaustively (by tokens first, then by their full sets); of larger nodes every class is compared with one pivot. If few are not linked to it,
those are compared with all others and the node is done; else the node branches on until it is small. Nodes still large at MAX_LEVEL are
compared in blocks, all against all. Two classes of similarity s miss each other in a tree with probability p = (s p + 1 - s)^2,
which is 0.03 at s = 0.85 and 0.06 at 0.8; four trees leave less than 2e-5.

Links are confirmed on the full sets. A comparison of two classes that are already connected inside the node is left
out, which changes no component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlake.llm.common import small_batches, tasks, text_key, written
from voltlake.llm.components import components
from voltlake.llm.textops import LOWER, U, mixed, sequences, spans, table, word_hashes

SHINGLE = 5
PERCENT = 85
COORDINATES = 128
TREES = 4
LEAF = 4096
FIRST_LEVEL = 2
MAX_LEVEL = 8
WEIGHT = 1 << 20  # shingles of the sets that one comparison holds, two sets at least
SLACK = 0.14  # estimates this far below the threshold still go to the exact check, four deviations and more

_SPACE = table(b" \t\n\r\x0b\x0c")
_RNG = np.random.default_rng(20240601)
_A = _RNG.integers(0, 1 << 31, COORDINATES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 1 << 32, COORDINATES, dtype=np.uint32)


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct n-word shingles; of a shorter text, of its whole word sequence."""
    buf = LOWER[np.frombuffer((text or "").encode(), dtype=np.uint8)]
    starts, ends = spans(~_SPACE[buf])
    if not len(starts):
        return np.empty(0, dtype=U)
    words = word_hashes(buf, starts, ends)
    return np.unique(sequences(words, min(n, len(words))) + U(max(0, n - len(words))))


def sketch(grams: np.ndarray) -> np.ndarray:
    """COORDINATES minwise tokens of a set."""
    out = np.full(COORDINATES, 0xFFFFFFFF, dtype=np.uint32)
    low = (grams ^ (grams >> U(32))).astype(np.uint32)
    for k in range(0, len(low), 2048):
        out = np.minimum(out, (low[None, k: k + 2048] * _A[:, None] + _B[:, None]).min(axis=1))
    return out


def embedded(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, tid, n, c, sketch) of every row; c names the set and is null for an empty one."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        for rows in batches:
            sets = [shingles(t, n) for t in rows.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                rows.column("doc_id"), rows.column("tid"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.array([sketch(s).tobytes() if len(s) else None for s in sets], pa.binary())], ["doc_id", "tid", "n", "c", "sketch"])

    return docs.select("doc_id", text_key(), "text").mapInArrow(run, "doc_id long, tid binary, n long, c binary, sketch binary")


def _children(node: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Two child nodes of every row: each chooses a coordinate by the node and is named by node, coordinate and token."""
    first = (mixed(node + U(1)) % U(COORDINATES)).astype(np.int64)
    second = (first + 1 + (mixed(node + U(2)) % U(COORDINATES - 1)).astype(np.int64)) % COORDINATES
    at = np.arange(len(node))
    return np.stack([mixed(node * U(0x9E3779B97F4A7C15) + (tokens[at, i].astype(U) << U(8)) + i.astype(U)) for i in (first, second)], axis=1)


def _tokens(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, COORDINATES)


def _start(classes: DataFrame, trees: int) -> DataFrame:
    """(node, c) at FIRST_LEVEL of all trees."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for rows in batches:
            if not rows.num_rows:
                continue
            tokens = _tokens(rows.column("sketch"))
            nodes = np.repeat(mixed(np.arange(1, trees + 1, dtype=U))[None, :], len(tokens), axis=0)
            for _ in range(FIRST_LEVEL):
                nodes = np.concatenate([_children(nodes[:, k], tokens) for k in range(nodes.shape[1])], axis=1)
            nodes = np.sort(nodes, axis=1)
            new = np.append(np.ones((len(nodes), 1), dtype=bool), nodes[:, 1:] != nodes[:, :-1], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[new].view(np.int64)), rows.column("c").take(pa.array(np.nonzero(new)[0]))], ["node", "c"])

    return classes.select("c", "sketch").mapInArrow(run, "node long, c binary")


def _branch(held: DataFrame) -> DataFrame:
    """The next level of rows (node, c, sketch)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for rows in batches:
            if not rows.num_rows:
                continue
            nodes = _children(rows.column("node").to_numpy(zero_copy_only=False).view(U), _tokens(rows.column("sketch")))
            own = pa.array(np.repeat(np.arange(rows.num_rows), 2))
            yield pa.RecordBatch.from_arrays([pa.array(nodes.ravel().view(np.int64)), rows.column("c").take(own)], ["node", "c"])

    return held.select("node", "c", "sketch").mapInArrow(run, "node long, c binary").dropDuplicates(["node", "c"])


def _likely(classes: DataFrame, groups: DataFrame, percent: float, labels: DataFrame | None = None, forest: bool = False) -> DataFrame:
    """Of groups (g, c) of classes, what their tokens and set sizes allow to be linked, once, however many nodes hold it: (g, members, labels).

    ``labels`` (node, label) are classes that are connected already. With ``forest`` the pairs of a spanning forest of the closest estimates, else
    the parts that pairs of different labels connect.
    """
    least = percent / 100 - SLACK

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for rows in batches:
            found: dict[tuple, list | None] = {}
            for group in rows.column("rows").to_pylist():
                group.sort(key=lambda r: r["c"])
                tokens = np.stack([np.frombuffer(r["sketch"], dtype=np.uint32) for r in group])
                size = np.array([r["n"] for r in group])
                number: dict[bytes, int] = {}
                own = np.array([number.setdefault(r["label"], len(number)) for r in group])
                if len(number) == 1:
                    continue
                parts = (_forest if forest else _parts)(tokens, size, own, percent, least)
                for part in (piece for part in parts for piece in _pieces(part, size)):
                    found[tuple(group[i]["c"] for i in part)] = None if forest else [group[i]["label"] for i in part]
            yield pa.RecordBatch.from_arrays([pa.array([list(m) for m in found], pa.list_(pa.binary())), pa.array(list(found.values()), pa.list_(pa.binary()))], ["members", "labels"])

    held = groups.join(classes.select("c", "n", "sketch"), "c")
    held = held.withColumn("label", F.col("c")) if labels is None else held.join(labels, F.col("c") == F.col("node"), "left").withColumn("label", F.coalesce("label", "c"))
    held = held.groupBy("g").agg(F.collect_list(F.struct("c", "n", "sketch", "label")).alias("rows"))
    made = held.mapInArrow(run, "members array<binary>, labels array<binary>")
    return made.withColumn("g", F.md5(F.array_join(F.transform("members", F.hex), ""))).dropDuplicates(["g"])


def _near(tokens: np.ndarray, size: np.ndarray, own: np.ndarray, i: int, others: np.ndarray, percent: float) -> np.ndarray:
    """Estimated similarity of i to others; 0 where the label is the same or the sizes rule a link out."""
    may = (100 * np.minimum(size[others], size[i]) >= percent * np.maximum(size[others], size[i])) & (own[others] != own[i])
    out = np.zeros(len(others))
    at = np.flatnonzero(may)
    out[at] = (tokens[others[at]] == tokens[i]).mean(axis=1)
    return out


def _forest(tokens, size, own, percent: float, least: float) -> list[list[int]]:
    """Pairs of a spanning forest of highest estimates, grown from node to node, so that memory is linear in the group."""
    n, out = len(tokens), []
    best, to = np.full(n, -1.0), np.zeros(n, dtype=np.int64)
    left = np.ones(n, dtype=bool)
    for _ in range(n):
        i = int(np.argmax(np.where(left, best, -2.0)))
        if best[i] >= least:
            out.append(sorted((int(to[i]), i)))
        left[i] = False
        others = np.flatnonzero(left)
        near = _near(tokens, size, own, i, others, percent)
        better = near > best[others]
        best[others[better]] = near[better]
        to[others[better]] = i
    return out


def _parts(tokens, size, own, percent: float, least: float) -> list[list[int]]:
    """Parts of more than one member that likely pairs of different labels connect."""
    left, out = np.ones(len(tokens), dtype=bool), []
    for start in range(len(tokens)):
        if not left[start]:
            continue
        left[start] = False
        part, todo = [start], [start]
        while todo:
            i = todo.pop()
            others = np.flatnonzero(left)
            near = others[_near(tokens, size, own, i, others, percent) >= least]
            left[near] = False
            part += near.tolist()
            todo += near.tolist()
        if len(part) > 1:
            out.append(sorted(part))
    return out


def _pieces(part: list[int], size: np.ndarray, weight: int | None = None) -> list[list[int]]:
    """A part whose sets are too large to be held together as pairs of blocks, so that every two members still meet."""
    weight = WEIGHT if weight is None else weight
    if len(part) < 3 or size[part].sum() <= weight:
        return [part]
    blocks, held = [[]], 0
    for i in part:
        if blocks[-1] and held + size[i] > weight // 2:
            blocks.append([])
            held = 0
        blocks[-1].append(i)
        held += size[i]
    return [blocks[x] + blocks[y] for y in range(len(blocks)) for x in range(y)] or [part]


def _root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _confirmed(parts: DataFrame, texts: DataFrame, percent: float, n: int, level: int = 0) -> DataFrame:
    """Links (a, b) of each part (g, members, labels): a is the first, in the order of the level, of the members its full sets connect, b another one.

    Members of one label are connected beforehand and not compared.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for rows in batches:
            a, b = [], []
            for group in rows.column("rows").to_pylist():
                group.sort(key=lambda r: _rank(level, r["c"]))
                sets = [shingles(r["text"], n) for r in group]
                parent, first = list(range(len(group))), {}
                for i, r in enumerate(group):
                    parent[i] = first.setdefault(r["label"] or r["c"], i)
                known = list(parent)
                for i in range(len(group)):
                    for j in range(i + 1, len(group)):
                        ri, rj = _root(parent, i), _root(parent, j)
                        if ri == rj or 100 * min(len(sets[i]), len(sets[j])) < percent * max(len(sets[i]), len(sets[j])):
                            continue
                        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                        if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                            parent[max(ri, rj)] = min(ri, rj)
                for i in range(len(group)):
                    if (r := _root(parent, i)) != _root(known, i):
                        a.append(group[r]["c"])
                        b.append(group[i]["c"])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    members = F.arrays_zip("members", F.coalesce("labels", F.array_repeat(F.lit(None).cast("binary"), F.size("members"))).alias("labels"))
    each = parts.select("g", F.explode(members).alias("m")).select("g", F.col("m.members").alias("c"), F.col("m.labels").alias("label"))
    held = each.join(texts, "c").groupBy("g").agg(F.collect_list(F.struct("c", "text", "label")).alias("rows"))
    return held.mapInArrow(run, "a binary, b binary")


def _rank(level: int, c: bytes) -> bytes:
    return hashlib.md5(bytes([level]) + c).digest()


def _texts(docs: DataFrame, classes: DataFrame, parts: DataFrame) -> DataFrame:
    """(c, text) of the members of the parts: one text each."""
    need = parts.select(F.explode("members").alias("c")).distinct().join(classes.select("c", "tid"), "c")
    return docs.select(text_key(), "text").join(need, "tid").groupBy("c").agg(F.first("text").alias("text"))


def _stars(large: DataFrame, docs: DataFrame, classes: DataFrame, percent: float, n: int, level: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) of the members of large nodes (node, c, size) to one pivot each, confirmed on full sets, and the members (node, c, size) that are not linked to it."""
    pivots = large.groupBy("node").agg(F.min_by("c", F.unhex(F.md5(F.concat(F.unhex(F.lit(f"{level:02X}")), "c")))).alias("pivot"))
    pivots = written(pivots.withColumnRenamed("node", "at"), "pivots")
    # the members of a large node are dealt into chunks, each with the node's pivot
    chunks = large.join(pivots, F.col("node") == F.col("at")).withColumn("k", F.pmod(F.xxhash64("c"), F.ceil(F.col("size") / 40)))
    parts = chunks.groupBy("pivot", "node", "k").agg(F.array_sort(F.collect_set("c")).alias("members"))
    parts = parts.withColumn("members", F.array_union(F.array("pivot"), "members")).select("members", F.lit(None).cast("array<binary>").alias("labels"))
    parts = written(parts.withColumn("g", F.md5(F.array_join(F.transform("members", F.hex), ""))).dropDuplicates(["g"]).select("g", "members", "labels"), "stars")
    links = written(_confirmed(parts, _texts(docs, classes, parts), percent, n, level), "star-links")
    linked = links.select(F.col("b").alias("c"), F.col("a").alias("pivot")).distinct()
    rest = large.join(pivots, F.col("node") == F.col("at")).filter("c != pivot").join(linked, ["c", "pivot"], "left_anti").select("node", "c", "size")
    return links, written(rest, "not-linked")


def _against_rest(large: DataFrame, rest: DataFrame, leaf: int) -> DataFrame:
    """(g, c): the members of a large node in chunks, each chunk with all of the node's ``rest``, of which there are at most leaf / 2."""
    half = max(1, leaf // 2)
    count = F.ceil(F.col("size") / half).cast("int")
    own = large.withColumn("k", F.pmod(F.xxhash64("c"), count).cast("int"))
    others = rest.withColumn("k", F.explode(F.sequence(F.lit(0), count - 1)))
    return own.select("node", "k", "c").union(others.select("node", "k", "c")).select(F.concat_ws(":", "node", "k").alias("g"), "c").distinct()


def links(docs: DataFrame, classes: DataFrame, percent: float = PERCENT, n: int = SHINGLE, trees: int = TREES, leaf: int = LEAF) -> list[DataFrame]:
    """Tables (a, b) of links between classes of similar sets, enough of them to connect every component."""
    nodes, found, small = written(_start(classes, trees), "nodes"), [], []
    for level in range(FIRST_LEVEL, MAX_LEVEL + 1):
        size = written(nodes.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1"), "sizes")
        alive = written(nodes.join(size, "node"), "alive")
        small.append(alive.filter(F.col("size") <= leaf).groupBy("node").agg(F.array_sort(F.collect_list("c")).alias("members")).select("members"))
        if size.filter(F.col("size") > leaf).isEmpty():
            break
        large = alive.filter(F.col("size") > leaf)
        star, rest = _stars(large, docs, classes, percent, n, level)
        found.append(star)
        # few classes that are not linked to the pivot: they meet all others of the node, which are connected already
        many = written(rest.groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") > max(1, leaf // 2)).select("node"), "many")
        groups = _against_rest(large.join(rest.select("node").distinct(), "node", "left_semi"), rest, leaf) if level < MAX_LEVEL and many.isEmpty() else None
        if groups is None:
            few = rest.join(many, "node", "left_anti")
            groups = _against_rest(large.join(few.select("node").distinct(), "node", "left_semi"), few, leaf)
            large = large.join(many, "node", "left_semi")
            groups = groups.union(_blocks(large, leaf)) if level == MAX_LEVEL else groups
        small.append(groups.groupBy("g").agg(F.array_sort(F.collect_list("c")).alias("members")).select("members"))
        if level == MAX_LEVEL or many.isEmpty():
            break
        nodes = written(_branch(large.select("node", "c").join(classes.select("c", "sketch"), "c")), "nodes")
    lists = _all(small)
    lists = lists.withColumn("g", F.md5(F.array_join(F.transform("members", F.hex), ""))).dropDuplicates(["g"])
    groups = written(lists.select("g", F.explode("members").alias("c")), "groups")
    labels = written(components(_all(found)), "star-labels") if found else None
    # the closest estimates first: most links are among them, and each is confirmed once
    pairs = written(_likely(classes, groups, percent, labels, forest=True), "pairs")
    found.append(written(_confirmed(pairs, _texts(docs, classes, pairs), percent, n), "pair-links"))
    known = written(components(_all(found)), "known")
    # then whatever may link two components
    rest = written(_likely(classes, groups, percent, known), "rest")
    last = written(_confirmed(rest, _texts(docs, classes, rest), percent, n), "rest-links")
    return [known.select(F.col("node").alias("a"), F.col("label").alias("b")), last]


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def _blocks(large: DataFrame, leaf: int) -> DataFrame:
    """Pairs of blocks of each node, every two blocks in one group, so that all its classes meet."""
    half = max(1, leaf // 2)
    count = F.ceil(F.col("size") / half).cast("int")
    own = large.withColumn("m", count).withColumn("k", F.pmod(F.xxhash64("c"), F.col("m")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("m") - 1))
    paired = own.withColumn("o", other)
    return paired.select(F.concat_ws(":", "node", F.least("k", "o"), F.greatest("k", "o")).alias("g"), "c").distinct()


def near_duplicates(docs: DataFrame, percent: float = PERCENT, n: int = SHINGLE, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """(doc_id, tid, n_shingles, component_id, kept) of every row; tid is the md5 of the text.

    A null text or one without words has an empty set and is linked with nothing, not even its copies. component_id is
    the smallest id of the component, nulls aside; a row is kept if it has that id, so rows that repeat it are all kept.
    Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = written(embedded(docs, n), "shingled")
    classes = written(
        rows.filter("c is not null").groupBy("c").agg(F.min("tid").alias("tid"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes")
    known, last = links(docs, classes, percent, n, trees, leaf)
    found = written(components(known.union(last)), "components") if not last.isEmpty() else known.withColumnsRenamed({"a": "node", "b": "label"})
    named = rows.select("doc_id", "tid", "n", "c").join(found, F.col("c") == F.col("node"), "left").select("doc_id", "tid", "n", F.coalesce("label", "c").alias("label"))
    named = written(named, "named")
    # a written table, so that the join below reads plain shuffles, of which that of a hot component can be split
    first = written(named.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("first")).withColumnRenamed("label", "of"), "first")
    out = named.join(first, F.col("label") == F.col("of"), "left").withColumn("component_id", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("first")))
    return out.select("doc_id", "tid", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def representatives(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stand for their component; of rows that repeat id and text, one."""
    kept = near_duplicates(docs, **options).filter("kept").groupBy(F.col("doc_id").alias("_vl_id"), F.col("tid").alias("_vl_tid")).agg(F.count("*").alias("n"))
    kept = written(kept, "kept")
    tid = F.unhex(F.md5(F.coalesce(docs["text"], F.lit(""))))
    out = docs.join(kept, docs["doc_id"].eqNullSafe(F.col("_vl_id")) & (tid == F.col("_vl_tid")), "left_semi")
    if kept.filter("n > 1").isEmpty():
        return out
    return out.withColumn("_vl_key", F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce("text", F.lit(""))))).dropDuplicates(["_vl_key"]).drop("_vl_key")
