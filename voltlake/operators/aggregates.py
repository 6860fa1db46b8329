"""Summaries of the gold layer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltlake.functions.scalars import money_sum, r6, ratio, share


def monthly_usage(usage: DataFrame, key: str, ts: str) -> DataFrame:
    return usage.groupBy(key, F.date_format(ts, "yyyy-MM").alias("month")).agg(
        money_sum("qty").alias("usage"), r6(money_sum("amount", 4)).alias("amount"), F.count("*").alias("n"))


def with_subtotals(df: DataFrame, levels: list[list[str]], dims: list[str], aggs: list[Column]) -> DataFrame:
    """Aggregates at several levels at once; a dimension that is summed over reads ``ALL``.

    Names are filled after aggregating with the grouping flag, so a null in the data stays apart from a subtotal.
    """
    flags = {d: f"_sub_{d}" for d in dims}
    g = df.groupingSets(levels, *dims).agg(*aggs, *[F.grouping(d).alias(flag) for d, flag in flags.items()])
    return g.select(
        *[F.when(F.col(flag) == 1, "ALL").otherwise(F.col(d)).alias(d) for d, flag in flags.items()],
        *[c for c in g.columns if c not in dims and c not in flags.values()])


def high_risk(df: DataFrame, score: str, label: str, threshold: float) -> DataFrame:
    hit = F.col(score) >= threshold
    return df.agg(F.count("*").alias("predictions_count"), F.count_if(hit).alias("high_risk_count"),
                  r6(share(hit) * 100).alias("high_risk_pct"), r6(F.avg(label)).alias("churn_rate"))


def daily_rate(df: DataFrame, date: str, hit: Column, as_of: str, days: int) -> DataFrame:
    """Daily rate over the last ``days`` days up to ``as_of``; days without rows have a null rate."""
    spark = df.sparkSession
    last = F.lit(as_of).cast("date")
    spine = spark.range(days).select(F.date_sub(last, F.col("id").cast("int")).alias("d"))
    recent = df.where((F.col(date) > F.date_sub(last, days)) & (F.col(date) <= last))
    rates = recent.groupBy(F.col(date).alias("d")).agg(F.count("*").alias("n"), r6(share(hit)).alias("rate"))
    return spine.join(rates, "d", "left").select("d", F.coalesce("n", F.lit(0)).alias("n"), "rate")


def row_stats(df: DataFrame, ts: str, as_of: str) -> DataFrame:
    """Rows, completeness over all cells, last change and hours since then."""
    nulls = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in df.columns])
    hours = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.max(ts).cast("timestamp"))) / F.lit(3.6e9)
    return df.agg(F.count("*").alias("row_count"), r6(1 - ratio(nulls, F.count("*") * len(df.columns))).alias("completeness"),
                  F.max(ts).alias("last_modified"), r6(hours).alias("freshness_hours"))


def profile(df: DataFrame, numeric: list[str], text: list[str], exact: bool = True) -> DataFrame:
    """Nulls, distinct values, min, max and mean per column.

    Distinct counts are exact by default: one shuffle per column on its values. ``exact=False`` takes a sketch, which
    needs no shuffle of values at all.
    """
    cols = [*numeric, *text]
    basics = df.agg(*[a for c in cols for a in (
        F.count_if(F.col(c).isNull()).alias(f"{c}|nulls"), F.min(c).cast("string").alias(f"{c}|min"),
        F.max(c).cast("string").alias(f"{c}|max"),
        (r6(F.avg(c)) if c in numeric else F.lit(None).cast("double")).alias(f"{c}|mean"))],
        *([] if exact else [F.approx_count_distinct(c).alias(f"{c}|distinct") for c in cols]))
    fields = ["nulls", "min", "max", "mean"] + ([] if exact else ["distinct"])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}|{f}`").alias(f) for f in fields]) for c in cols])
    out = basics.select(F.inline(cells))
    if exact:
        one = [df.select(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in cols]
        pairs = reduce(DataFrame.unionAll, one).where(F.col("v").isNotNull()).groupBy("column", "v").agg(F.lit(1).alias("one"))
        distinct = pairs.groupBy("column").agg(F.sum("one").alias("distinct"))
        out = out.join(distinct, "column", "left").withColumn("distinct", F.coalesce("distinct", F.lit(0)))
    return out.select("column", "nulls", "distinct", "min", "max", "mean")
