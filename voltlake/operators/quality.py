"""Data contracts: an expectation suite runs as one aggregate over the table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltlake.functions.ordered import trailing_total
from voltlake.functions.scalars import r6, ratio
from voltlake.operators.cleanse import EMAIL_PATTERN
from voltlake.tables import micros


@dataclass(frozen=True)
class Expect:
    """One expectation; ``kind`` is not_null, unique, between, regex or row_count."""

    kind: str
    column: str = "*"
    low: float | None = None
    high: float | None = None
    pattern: str | None = None

    def fails(self) -> Column | None:
        """Row-level failure. Nulls pass every check but ``not_null``."""
        c = F.col(self.column) if self.column != "*" else None
        if self.kind == "not_null":
            return c.isNull()
        if self.kind == "between":
            return ~F.coalesce(c.between(self.low, self.high), F.lit(True))
        if self.kind == "regex":
            return ~F.coalesce(c.rlike(self.pattern), F.lit(True))
        return None


# The example contract of customers and the row-count bounds of every other example.
CUSTOMER_SUITE = (
    Expect("not_null", "customer_id"),
    Expect("unique", "customer_id"),
    Expect("between", "age", 18, 120),
    Expect("regex", "email", pattern=EMAIL_PATTERN),
)
GENERIC_BOUNDS = (1, 10_000_000)


def suite_for(contract: str, low: int = 1, high: int | None = None) -> tuple[Expect, ...]:
    """Checks of a contract; the bounds of the row count are the contract's own, without ``high`` there is none above."""
    return CUSTOMER_SUITE if "customer" in contract.lower() else (Expect("row_count", low=low, high=high),)


def within(n: Column, low: float | None, high: float | None) -> Column:
    """``low <= n <= high``; a bound that is none does not bind."""
    above = F.lit(True) if low is None else n >= int(low)
    return above if high is None else above & (n <= int(high))


def validate(df: DataFrame, suite: tuple[Expect, ...] | list[Expect]) -> DataFrame:
    """One row per expectation: kind, column, rows checked, rows failing, success.

    All row checks and the row count share one pass. Each uniqueness check is one count per value, reduced before the
    shuffle, so a value repeated a billion times is still a small row.
    """
    simple = [(i, e) for i, e in enumerate(suite) if e.kind != "unique"]
    parts = []
    if simple:
        one = df.agg(F.count("*").alias("n"), *[F.count_if(e.fails()).alias(f"f{i}") for i, e in simple if e.fails() is not None])
        cells = []
        for i, e in simple:
            bad = F.col(f"f{i}") if e.fails() is not None else F.when(within(F.col("n"), e.low, e.high), 0).otherwise(1).cast("long")
            cells.append(F.struct(F.lit(e.kind).alias("expectation"), F.lit(e.column).alias("column"), F.col("n").alias("evaluated"), bad.alias("unexpected")))
        parts.append(one.select(F.inline(F.array(*cells))))
    for e in suite:
        if e.kind == "unique":
            g = df.where(F.col(e.column).isNotNull()).groupBy(e.column).agg(F.count("*").alias("n"))
            parts.append(g.agg(
                F.coalesce(F.sum("n"), F.lit(0)).alias("evaluated"),
                F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("unexpected")).select(
                F.lit("unique").alias("expectation"), F.lit(e.column).alias("column"), "evaluated", "unexpected"))
    return reduce(DataFrame.unionByName, parts).withColumn("success", F.col("unexpected") == 0)


def statistics(results: DataFrame) -> DataFrame:
    ok = F.count_if("success")
    return results.agg(
        F.count("*").alias("evaluated_expectations"), ok.alias("successful_expectations"),
        (F.count("*") - ok).alias("unsuccessful_expectations"), r6(100 * ratio(ok, F.count("*"))).alias("success_percent"),
        F.min("success").alias("success"), r6(ratio(ok, F.count("*"))).alias("compliance_rate"))


def violations(df: DataFrame, key: str, suite: list[Expect]) -> DataFrame:
    """Failing rows, one output row per row and failed check, found in one pass."""
    checks = [F.when(e.fails(), F.struct(F.lit(e.kind).alias("expectation"), F.lit(e.column).alias("column"), F.col(e.column).cast("string").alias("found")))
              for e in suite if e.fails() is not None]
    return df.select(key, F.inline(F.array_compact(F.array(*checks))))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def score_window(df: DataFrame, keys: list[str], ts: str, passed: Column, seconds: int, target: float) -> DataFrame:
    pts = df.select(*keys, micros(ts).alias("at"), passed.cast("long").alias("ok"))
    t = trailing_total(pts, keys, "at", {"n": F.lit(1), "ok": F.col("ok")}, seconds, inclusive=True)
    return t.select(*keys, "at", r6(F.col("ok") / F.col("n")).alias("score"), (F.col("ok") / F.col("n") >= target).alias("met"))


def hourly(df: DataFrame, ts: str, passed: Column) -> DataFrame:
    return df.groupBy(F.date_trunc("hour", ts).alias("hour")).agg(F.count_if(passed).alias("passed"), F.count_if(~passed).alias("failed"))
