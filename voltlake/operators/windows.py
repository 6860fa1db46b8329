"""History, trailing windows and top rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voltlake.functions.ordered import neighbour, ranked, running_total, tile, time_slot, trailing_total
from voltlake.functions.scalars import ratio
from voltlake.tables import micros


def scd2(history: DataFrame, key: str, attrs: list[str], ts: str, seq: str, slot_seconds: int = 30 * 86400) -> DataFrame:
    """Validity intervals of a slowly changing dimension, type 2: one row per change of ``attrs``."""
    at = time_slot(micros(ts), slot_seconds)
    prev = neighbour(history, [key], at, [ts, seq], {**{f"_p_{a}": a for a in attrs}, "_p_seq": seq})
    same = F.col("_p_seq").isNotNull()
    for a in attrs:
        same = same & F.col(a).eqNullSafe(F.col(f"_p_{a}"))
    changes = prev.where(~same).select(*history.columns)
    nxt = neighbour(changes, [key], at, [ts, seq], {"valid_to": ts}, following=True)
    return nxt.select(key, *attrs, F.col(ts).alias("valid_from"), seq, "valid_to", F.col("valid_to").isNull().alias("is_current"))


def scd2_merge(dimension: DataFrame, increment: DataFrame, key: str, attrs: list[str], ts: str, seq: str) -> DataFrame:
    """Merge new rows into a dimension: keys of the increment are recomputed, all other rows pass through."""
    touched = increment.select(key).distinct()
    again = dimension.join(touched, key, "left_semi").select(key, *attrs, F.col("valid_from").alias(ts), seq)
    fresh = scd2(again.unionByName(increment.select(key, *attrs, ts, seq)), key, attrs, ts, seq)
    return dimension.join(touched, key, "left_anti").unionByName(fresh)


def last_n(df: DataFrame, key: str, order: str, n: int | None) -> DataFrame:
    """Last ``n`` rows per key; all rows when ``n`` is none or 0.

    The rank filter is applied before the shuffle as well, so at most ``n`` rows per key and input partition move.
    """
    if not n:
        return df
    w = W.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def order_features(orders: DataFrame, key: str, ts: str, seq: str) -> DataFrame:
    """Days since the previous order, spend of the previous order and order number, per order."""
    slot = time_slot(micros(ts), 90 * 86400)
    prev = neighbour(orders, [key], slot, [ts, seq], {"prev_ts": ts, "prev_total": "o_totalprice"})
    numbered = running_total(prev, [key], slot, [ts, seq], {"order_no": F.lit(1)})
    return numbered.withColumn("gap_days", F.datediff(F.col(ts).cast("date"), F.col("prev_ts").cast("date")))


def lift_deciles(df: DataFrame, score: str, label: str, key: str, n: int = 10) -> DataFrame:
    """Lift chart: deciles by falling score with response, cumulative gain and lift."""
    r = ranked(df.select((-F.col(score)).alias("_s"), label, key), "_s", key)
    d = r.groupBy(tile(F.col("rank_no"), F.col("rows_all"), n).alias("decile")).agg(F.count("*").alias("n"), F.sum(label).alias("positives"))
    up, every = W.orderBy("decile").rowsBetween(W.unboundedPreceding, 0), W.partitionBy()  # one row per decile
    rate = ratio("positives", "n")
    base = ratio(F.sum("positives").over(every), F.sum("n").over(every))
    return d.select("decile", "n", "positives", F.round(rate, 6).alias("response"),
                    F.round(ratio(F.sum("positives").over(up), F.sum("positives").over(every)), 6).alias("gain"),
                    F.round(ratio(rate, base), 6).alias("lift"))


def sliding(df: DataFrame, keys: list[str], ts: str, value: str, seconds: int) -> DataFrame:
    """Count and sum over the trailing span of every distinct (key, time)."""
    pts = df.select(*keys, micros(ts).alias("at"), F.col(value).cast("decimal(18,2)").alias("v"))
    return trailing_total(pts, keys, "at", {"n": F.lit(1), "total": F.col("v")}, seconds, inclusive=True)


def top_n(df: DataFrame, order: list, n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def first_occurrence(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c != key and c not in order]
    return df.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("r")).select(key, "r.*")


def day_spine(df: DataFrame, start: str, end: str) -> DataFrame:
    """All days of an inclusive range."""
    return df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("ds"))

