"""Connected components of a link table: links are contracted within tasks, then by large-star and small-star steps across them."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlake.llm.common import written

ROWS = 200_000  # links one task contracts


def forest(links) -> dict[bytes, bytes]:
    """Of links (a, b) the smallest node that each other node of them reaches."""
    parent: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x], x = top, up
        return top

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def _contracted(edges: DataFrame, parts: int) -> DataFrame:
    """(u, v) of as many tasks as ``parts``: of the links of each the nodes with the smallest they reach by them."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        found = forest(link for rows in batches for link in zip(rows.column("u").to_pylist(), rows.column("v").to_pylist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], ["u", "v"])

    return edges.repartition(parts).mapInArrow(run, "u binary, v binary")


def components(links: DataFrame, rows: int = ROWS) -> DataFrame:
    """(node, label) of every end of a link (a, b): the label is the smallest node that can be reached.

    A task holds at most ``rows`` links. Where there are more, minima are pre-aggregated, written and joined back, so that a hub is never
    gathered and its join can be split; every round is a written table.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v"), "links")
    n = edges.count()
    while n:
        parts = -(-n // rows)
        edges = written(_contracted(edges, parts), "links")
        if parts == 1:
            break
        n = edges.count()
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m")), "minima")
        large = both.filter("v > u").join(low, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        large = written(large.distinct(), "links")
        # after the large step every edge leads to a smaller node
        least = written(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "x"), "minima")
        small = large.join(least, F.col("u") == F.col("x")).select(F.col("v").alias("p"), "u", "m")
        moved = small.select(F.col("p").alias("u"), F.col("m").alias("v")).union(least.select(F.col("x").alias("u"), F.col("m").alias("v"))).filter("u != v").distinct()
        new = written(moved, "links")
        size = new.count()
        # a forest of stars: no edge moved
        done = size == n and new.join(edges, ["u", "v"], "left_anti").isEmpty()
        edges, n = new, size
        if done:
            break
    return edges.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "node").union(
        edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("label")))
