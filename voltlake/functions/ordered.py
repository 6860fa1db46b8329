"""Ordered computations (running totals, neighbours, carried values, ranks) that survive a hot key.

A plain window over one key sorts that key in one task. So the order is cut into slots: each (key, slot) is windowed
alone, a small table with one row per (key, slot) is windowed per key, and its result is added to the rows of the
slot. A slot is any expression that never falls when the leading order column rises, nulls first: a span of time, or a range of
values cut at the data's own quantiles. There is one plan for every size, and null keys and values keep their rows, as in a window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLOT = "_slot"
Slot = Column | Callable[[], Column]


def join_back(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on keys that may be null; the columns of ``left`` and the other columns of ``right``."""
    if not keys:
        return left.crossJoin(F.broadcast(right))  # one row
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(other, same, how).drop(*[f"_r_{k}" for k in keys])


def _slot(slot: Slot) -> Column:
    return slot() if callable(slot) and not isinstance(slot, Column) else slot


def slot_count(df: DataFrame) -> int:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(8, min(1024, 2 * parts))


def value_slot(df: DataFrame, column: str, slots: int | None = None) -> Column:
    """Slot of a numeric column, cut at approximate quantiles; at most 1024 numbers reach the driver."""
    n = slots or slot_count(df)
    cuts = df.select(F.col(column).cast("double").alias("x")).approxQuantile("x", [i / n for i in range(1, n)], 1.0 / (4 * n))
    return _search(column, sorted(set(cuts)))


def _search(column: str, cuts: list[float]) -> Column:
    def tree(lo: int, hi: int) -> str:
        if lo >= hi:
            return str(lo)
        mid = (lo + hi) // 2
        return f"if(cast(`{column}` as double) < {cuts[mid]!r}D, {tree(lo, mid)}, {tree(mid + 1, hi)})"

    return F.when(F.col(column).isNull(), F.lit(-1)).otherwise(F.expr(tree(0, len(cuts))))


def time_slot(micros: Column, seconds: int = 86400) -> Column:
    return F.floor(micros / F.lit(seconds * 1_000_000)).cast("long")


def running_total(df: DataFrame, keys: list[str], slot: Slot, order: list, totals: dict[str, Column],
                  whole: bool = False) -> DataFrame:
    """Add inclusive running sums in ``order`` per key; with ``whole`` also the key's total as ``<name>_all``."""
    base = df.withColumn(SLOT, _slot(slot))
    per = [*keys, SLOT]
    w = W.partitionBy(*per).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = base.select("*", *[F.sum(c).over(w).alias(f"_run_{n}") for n, c in totals.items()])
    sums = base.groupBy(*per).agg(*[F.sum(c).alias(f"_sum_{n}") for n, c in totals.items()])
    before = W.partitionBy(*keys).orderBy(SLOT).rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(
        *per,
        *[F.sum(f"_sum_{n}").over(before).alias(f"_off_{n}") for n in totals],
        *([F.sum(f"_sum_{n}").over(W.partitionBy(*keys)).alias(f"{n}_all") for n in totals] if whole else []),
    )
    out = join_back(local, offsets, per)
    zero = F.lit(0)
    return out.select(
        *df.columns,
        *[(F.col(f"_run_{n}") + F.coalesce(F.col(f"_off_{n}"), zero)).alias(n) for n in totals],
        *([F.col(f"{n}_all") for n in totals] if whole else []),
    )


def carry_last(df: DataFrame, keys: list[str], slot: Slot, order: list[str], columns: list[str]) -> DataFrame:
    """Replace each of ``columns`` by its last non-null value at or before the row."""
    others = [c for c in df.columns if c not in columns]
    base = df.withColumn(SLOT, _slot(slot))
    per = [*keys, SLOT]
    w = W.partitionBy(*per).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = base.select("*", *[F.last(c, ignorenulls=True).over(w).alias(f"_loc_{c}") for c in columns])
    at = F.struct(*order)
    ends = base.groupBy(*per).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(f"_end_{c}") for c in columns])
    before = W.partitionBy(*keys).orderBy(SLOT).rowsBetween(W.unboundedPreceding, -1)
    prior = ends.select(*per, *[F.last(f"_end_{c}", ignorenulls=True).over(before).alias(f"_pri_{c}") for c in columns])
    return join_back(local, prior, per).select(
        *others, *[F.coalesce(F.col(f"_loc_{c}"), F.col(f"_pri_{c}")).alias(c) for c in columns])


def neighbour(df: DataFrame, keys: list[str], slot: Slot, order: list[str], names: dict[str, str],
              following: bool = False) -> DataFrame:
    """Add ``new = column of the previous row`` (or of the following one) for each ``new: column`` of ``names``."""
    step = F.lead if following else F.lag
    base = df.withColumn(SLOT, _slot(slot))
    per = [*keys, SLOT]
    row = F.struct(*[F.col(c).alias(n) for n, c in names.items()])
    w = W.partitionBy(*per).orderBy(*order)
    edge = F.min_by if following else F.max_by
    local = base.withColumn("_row", row).withColumn("_near", step("_row").over(w))
    ends = base.groupBy(*per).agg(edge(row, F.struct(*order)).alias("_edge"))
    far = ends.select(*per, step("_edge").over(W.partitionBy(*keys).orderBy(SLOT)).alias("_far"))
    near = F.coalesce(F.col("_near"), F.col("_far"))
    return join_back(local, far, per).select(*df.columns, *[near[n].alias(n) for n in names])


def trailing_total(df: DataFrame, keys: list[str], at: str, totals: dict[str, Column], seconds: int,
                   inclusive: bool = False, slot_seconds: int = 3600) -> DataFrame:
    """Per distinct (key, time in micros): sums over the trailing span ending at that time.

    Every point enters once when it happens and leaves once when the span has passed, so a running total of both
    replaces a range frame. ``inclusive`` keeps a point that is exactly one span old.
    """
    points = df.groupBy(*keys, at).agg(*[F.sum(c).alias(n) for n, c in totals.items()])
    enter = points.withColumn("_leaves", F.lit(0))
    leave = points.select(
        *keys, (F.col(at) + F.lit(seconds * 1_000_000)).alias(at), *[(-F.col(n)).alias(n) for n in totals], F.lit(1).alias("_leaves"))
    phase = F.when(F.col("_leaves") == 1, 2 if inclusive else 0).otherwise(1)
    both = enter.unionByName(leave).withColumn("_phase", phase)
    run = running_total(both, keys, time_slot(F.col(at), slot_seconds), [at, "_phase"], {f"_t_{n}": F.col(n) for n in totals})
    return run.where("_leaves = 0").select(*keys, at, *[F.col(f"_t_{n}").alias(n) for n in totals])


def ranked(df: DataFrame, score: str, tie: str) -> DataFrame:
    """Add ``rank_no`` (1 = lowest score, ties by ``tie``, a unique number) and ``rows_all`` over the whole frame."""
    scores = df.groupBy(score).agg(F.count("*").alias("_n"))
    placed = running_total(scores, [], lambda: value_slot(df, score), [score], {"_upto": F.col("_n")}, whole=True).select(
        score, (F.col("_upto") - F.col("_n")).alias("_below"), F.col("_upto_all").alias("rows_all"))
    inner = running_total(df, [score], lambda: value_slot(df, tie), [tie], {"_place": F.lit(1)})
    return join_back(inner, placed, [score]).select(*df.columns, (F.col("_below") + F.col("_place")).alias("rank_no"), "rows_all")


def tile(rank: Column, rows: Column, n: int) -> Column:
    """SQL ``ntile``: the first ``rows % n`` tiles get one row more."""
    size, extra = F.floor(rows / F.lit(n)), rows % F.lit(n)
    wide = extra * (size + 1)
    i = rank - 1
    return (F.when(i < wide, F.floor(i / (size + 1))).otherwise(extra + F.floor((i - wide) / size)) + 1).cast("int")


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, values: list[str],
         slot_seconds: int = 86400) -> DataFrame:
    """For each left row the latest right row of the key at or before it; times are micros. Values are null if none."""
    pick = F.struct(F.col(right_at).alias("_at"), *values)
    payload = F.struct(*left.columns)
    lt = left.select(*keys, F.col(left_at).alias("_t"), F.lit(1).alias("_side"), payload.alias("_left"))
    rt = right.groupBy(*keys, F.col(right_at).alias("_t")).agg(F.max(pick).alias("_hit")).withColumn("_side", F.lit(0))
    both = lt.unionByName(rt, allowMissingColumns=True)
    found = carry_last(both, keys, time_slot(F.col("_t"), slot_seconds), ["_t", "_side"], ["_hit"])
    return found.where("_side = 1").select("_left.*", F.col("_hit._at").alias(right_at), *[F.col(f"_hit.{v}").alias(v) for v in values])
