"""Prefix trie of rebuilt conversations, its subtree totals by time-forward processing.

A node is a distinct sequence of first turns, named by a chained hash. Nodes that more than total / SHARDS rows of all paths go through are
the top of the trie; as every such node takes that many rows of its own, there are fewer than SHARDS of them. Each other
node belongs to the shard of its highest ancestor below the top, so that no shard is large however many conversations share a
first turn. The nodes of a task's shards are sorted in reverse level order (Spark's external sort) and read once: a node takes the totals its children have
sent from a priority queue, which spills to sorted runs, and sends its own on to its parent. The roots of the shards send theirs to the top, where the same
is done once more. Conversations are read as sorted streams, turn by turn, so their length does not matter to memory.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltlake.llm.common import small_batches, tasks, written

GROUP = 20
PREFIXES = 4
SHARDS = 4096
HELD = 200_000  # messages in memory
ROOT = bytes(16)
ID_BIN = 4096  # ids of one node joined to one text at once


class SpillQueue:
    """A priority queue of tuples that keeps at most ``held`` in memory and the largest others as sorted runs in temporary files."""

    def __init__(self, held: int = HELD):
        self.held, self.heap, self.heads, self.files = max(2, held), [], [], []

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.held:
            self.heap.sort()
            keep = self.held // 2
            file = tempfile.TemporaryFile()  # has no name, so it goes with the process
            for k in range(keep, len(self.heap), 1024):
                pickle.dump(self.heap[k: k + 1024], file)
            del self.heap[keep:]
            file.seek(0)
            self.files.append((file, iter(())))
            self._refill(len(self.files) - 1)

    def _refill(self, k: int) -> None:
        file, items = self.files[k]
        item = next(items, None)
        if item is None:
            try:
                items = iter(pickle.load(file))
            except EOFError:
                file.close()
                return
            self.files[k], item = (file, items), next(items)
        heapq.heappush(self.heads, (item, k))

    def least(self) -> tuple | None:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            return self.heads[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            item, k = heapq.heappop(self.heads)
            self._refill(k)
            return item
        return heapq.heappop(self.heap)


def _batch(rows: list[tuple], schema):
    import pyarrow as pa

    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def rebuilt(conversations: DataFrame, group: int = GROUP, prefixes: int = PREFIXES) -> DataFrame:
    """(conv_id, part, i, turn, words): the turns of every rebuilt conversation in the order of part and i. A null turn only shows that the conversation exists."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter("conv_id is not null").select(
        "conv_id", F.col("turn").alias("at"), F.unhex(F.md5(F.concat(F.md5(role), F.md5(text)))).alias("turn"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    order = Window.partitionBy("conv_id").orderBy(F.col("at").asc_nulls_first(), "turn")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % prefixes
    turns = written(rows.select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("i"), h.alias("h"), "turn", "words"), "turns")
    own = turns.select("conv_id", F.lit(1).alias("part"), "i", F.when(F.col("i") >= F.col("h"), F.col("turn")).alias("turn"), "words")
    heads = turns.filter(f"conv_id % {group} = 0 and i < {prefixes - 1}").select(F.col("conv_id").alias("base"), F.col("i").alias("k"), "turn", "words")
    need = turns.filter("i = 0 and h > 0").select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("of"), "h")
    copied = need.join(heads, (F.col("of") == F.col("base")) & (F.col("k") < F.col("h"))).select("conv_id", F.lit(0).alias("part"), F.col("k").alias("i"), "turn", "words")
    return written(own.union(copied), "rebuilt")


def _paths(turns: DataFrame, top: frozenset[bytes] | None) -> DataFrame:
    """The nodes of every conversation from the root down. Without ``top`` their names only; with it (node, parent, depth, words, shard, conv_id, last), the shard null in the top."""

    def walk(conv_id: int) -> tuple:
        return [ROOT, None, 0, 0, None if ROOT in top else ROOT, conv_id, False]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("node", pa.binary())] + ([("parent", pa.binary()), ("depth", pa.int64()), ("words", pa.int64()), ("shard", pa.binary()), ("conv_id", pa.int64()), ("last", pa.bool_())] if top is not None else []))
        row, out, md5 = None, [], hashlib.md5
        own, node = None, ROOT
        for rows in batches:
            for c, turn, words in zip(*(rows.column(x).to_pylist() for x in ("conv_id", "turn", "words")), strict=True):
                if top is None:
                    if c != own:
                        own, node = c, ROOT
                        out.append((ROOT,))
                    if turn is not None:
                        node = md5(node + turn).digest()
                        out.append((node,))
                    continue
                if row is None or c != row[5]:
                    if row:
                        out.append((*row[:6], True))
                    row = walk(c)
                if turn is not None:
                    out.append(tuple(row))
                    name = md5(row[0] + turn).digest()
                    shard = row[4] or (None if name in top else name)
                    row = [name, row[0], row[2] + 1, words, shard, c, False]
            if len(out) >= 4096:
                yield _batch(out, schema)
                out = []
        if row:
            out.append((*row[:6], True))
        yield _batch(out, schema)

    spread = turns.repartition(tasks(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part", "i")
    more = ", parent binary, depth long, words long, shard binary, conv_id long, last boolean" if top is not None else ""
    return spread.mapInArrow(run, "node binary" + more)


_TOTALS = "node binary, parent binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, up boolean"


def _totals(nodes: DataFrame, held: int) -> DataFrame:
    """Subtree totals of rows (node, parent, depth, words, shard, conv_id, n_convs, children, leaves, saved), each partition in reverse level order and closed under
    parents up to its shard roots. The last three are what a node gets from elsewhere."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.binary()] * 2 + [pa.int64()] * 6 + [pa.bool_()]
        schema = pa.schema([(c.split()[0], k) for c, k in zip(_TOTALS.split(", "), kinds, strict=True)])
        queue = SpillQueue(held)
        for rows in batches:
            out = []
            for node, parent, depth, words, shard, conv_id, n, children, leaves, saved in zip(*(rows.column(k).to_pylist() for k in range(10)), strict=True):
                key = (-depth, node)
                while (m := queue.least()) and m[:2] == key:
                    queue.pop()
                    children, leaves, saved = children + 1, leaves + m[2], saved + m[3]
                saved += (n - 1) * words
                leaves = leaves or 1
                up = shard == node
                if parent is not None and not up:
                    queue.push((1 - depth, parent, leaves, saved))
                out.append((node, parent, depth, conv_id, n, children, leaves, saved, up))
            yield _batch(out, schema)

    return nodes.select("node", "parent", "depth", "words", "shard", "conv_id", "n_convs", "children", "leaves", "saved").mapInArrow(run, _TOTALS)


def _ends(paths: DataFrame) -> DataFrame:
    """(end_node, ends_sha256): SHA-256 of the ids, in order, of the conversations that end at a node. Ids are joined ID_BIN wide first, then streamed through the hash."""
    bins = paths.filter("last").groupBy("node", F.floor(F.col("conv_id") / ID_BIN).alias("bin")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    pieces = bins.select("node", "bin", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("end_node", pa.binary()), ("ends_sha256", pa.string())])
        own = made = None
        for rows in batches:
            out = []
            for node, ids in zip(rows.column("node").to_pylist(), rows.column("ids").to_pylist(), strict=True):
                if node == own:
                    made.update(b",")
                else:
                    if own is not None:
                        out.append((own, made.hexdigest()))
                    own, made = node, hashlib.sha256()
                made.update(ids.encode())
            yield _batch(out, schema)
        if own is not None:
            yield _batch([(own, made.hexdigest())], schema)

    spread = pieces.repartition(tasks(paths.sparkSession), "node").sortWithinPartitions("node", "bin")
    return spread.mapInArrow(run, "end_node binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, group: int = GROUP, prefixes: int = PREFIXES, shards: int = SHARDS, held: int = HELD) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node.

    Turns are ordered by turn, nulls first, ties by a hash of role and text; rows that repeat all of them are turns of their own. A null role or text is empty, a
    very long text is hashed whole. Rows without conv_id are left out; a table without others has no node, not even the root. Other columns are ignored.
    """
    spark = conversations.sparkSession
    small_batches(spark)
    turns = rebuilt(conversations, group, prefixes)
    counts = written(_paths(turns, None).groupBy("node").agg(F.count("*").alias("n")), "node-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    top = frozenset(bytes(r["node"]) for r in counts.filter(F.col("n") > total / shards).select("node").collect())  # fewer than ``shards``, see above
    paths = written(_paths(turns, top), "paths")
    nodes = written(paths.groupBy("node", "parent", "depth", "words", "shard").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")), "nodes")
    zero = {c: F.lit(0).cast("long") for c in ("children", "leaves", "saved")}
    below = nodes.filter("shard is not null").withColumns(zero).repartition(tasks(spark), "shard").sortWithinPartitions(F.col("depth").desc(), "node")
    low = written(_totals(below, held), "shard-totals")
    sent = low.filter("up").groupBy(F.col("parent").alias("to")).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    above = nodes.filter("shard is null").join(sent, F.col("node") == F.col("to"), "left").withColumns({c: F.coalesce(c, z) for c, z in zero.items()})
    high = written(_totals(above.coalesce(1).sortWithinPartitions(F.col("depth").desc(), "node"), held), "top-totals")
    # parents in the top: fewer than ``shards`` rows are sent to all tasks; other parents have few children each
    of_top = high.union(low.filter("up")).join(F.broadcast(high.select(F.col("node").alias("p"), F.col("conv_id").alias("parent_conv_id"))), F.col("parent") == F.col("p"), "left")
    of_low = low.filter("not up").join(low.select(F.col("node").alias("p"), F.col("conv_id").alias("parent_conv_id")), F.col("parent") == F.col("p"))
    ends = written(_ends(paths), "ends")
    out = of_top.union(of_low.select(*of_top.columns)).join(ends, F.col("node") == F.col("end_node"), "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def prefix_trie_sql(group: int = GROUP, prefixes: int = PREFIXES) -> str:
    """The same in SQL; every node meets all its ancestors."""
    step = "xor({0} >> 1, ({0} & 1) * 3988292384)".format("(case when k % 8 = 0 then xor(a, ascii(substr(c::varchar, (k // 8 + 1)::integer, 1))) else a end)")
    return f"""
with turns as (
  select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, md5(md5(coalesce(role, '')) || md5(coalesce(text, '')))) - 1 as i,
    md5(md5(coalesce(role, '')) || md5(coalesce(text, ''))) as t, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as w
  from conversations where conv_id is not null),
convs as (select c, xor(list_reduce(range(0, 8 * length(c::varchar)), lambda a, k: {step}, 4294967295::bigint), 4294967295) % {prefixes} as h from (select distinct c from turns)),
rebuilt as (
  select v.c, 0 as part, b.i, b.t, b.w from convs v join turns b on b.c = v.c - v.c % {group} and b.i < v.h
  union all select t.c, 1, t.i, t.t, t.w from turns t join convs v on t.c = v.c and t.i >= v.h),
placed as (select c, row_number() over (partition by c order by part, i) as d, string_agg(t, '') over (partition by c order by part, i rows unbounded preceding) as p, w from rebuilt),
paths as (select c, d, p, left(p, 32 * (d::integer - 1)) as up, w from placed union all select c, 0, '', null, 0 from convs),
nodes as (select d, p, any_value(up) as up, any_value(w) as w, min(c) as c, count(*) as n from paths group by d, p),
kids as (select up, count(*) as n from nodes where d > 0 group by up),
subtree as (
  select a.p, sum(case when k.n is null then 1 else 0 end) as leaves, sum((u.n - 1) * u.w) as saved
  from nodes u left join kids k on k.up = u.p join paths a on a.c = u.c and a.d <= u.d group by a.p),
ends as (select p, string_agg(c::varchar, ',' order by c) as ids from (select c, max_by(p, d) as p from paths group by c) group by p)
select n.c::bigint as conv_id, n.d::bigint as depth, m.c::bigint as parent_conv_id, n.n::bigint as n_convs, coalesce(k.n, 0)::bigint as n_children, s.leaves::bigint as n_leaves,
  s.saved::bigint as saved_tokens, sha256(coalesce(e.ids, '')) as ends_sha256
from nodes n left join nodes m on n.d > 0 and m.p = n.up left join kids k on k.up = n.p join subtree s on s.p = n.p left join ends e on e.p = n.p"""
