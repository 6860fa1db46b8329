"""Join shapes of the lake jobs. Join strategies are left to the optimizer unless a side has a fixed size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltlake.functions.ordered import asof, carry_last, value_slot
from voltlake.tables import micros

# Scenario shifts are part of the expression: each row is expanded in place instead of being cross joined.


def enrich_geography(df: DataFrame, nation: DataFrame, region: DataFrame, nation_key: str) -> DataFrame:
    """Nation and region names. Both tables have a fixed size (countries of the world), so they are broadcast."""
    dim = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    return df.join(F.broadcast(dim), F.col(nation_key) == F.col("n_nationkey"))


def full_parity(a: DataFrame, b: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Full outer join of two stores with one equality flag per feature; a key missing on one side differs."""
    left = a.select(*keys, *[F.col(c).alias(f"{c}_a") for c in features], F.lit(True).alias("in_a"))
    right = b.select(*keys, *[F.col(c).alias(f"{c}_b") for c in features], F.lit(True).alias("in_b"))
    j = left.join(right, keys, "full_outer")
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    return j.select(
        *keys, F.coalesce("in_a", F.lit(False)).alias("in_a"), F.coalesce("in_b", F.lit(False)).alias("in_b"),
        *[(both & F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b"))).alias(f"{c}_equal") for c in features])


def with_scenarios(df: DataFrame, scenarios: dict[str, float]) -> DataFrame:
    """Every row under every scenario of a fixed list: an in-place expansion, no join."""
    arr = F.array(*[F.struct(F.lit(k).alias("scenario"), F.lit(float(v)).alias("factor")) for k, v in scenarios.items()])
    return df.select("*", F.inline(arr))


def band(df: DataFrame, x: str, bands: DataFrame, lo: str, hi: str, name: str) -> DataFrame:
    """Band with ``lo <= x < hi`` of non-overlapping bands; null outside all of them.

    Bands are merged in order with the rows and carried forward, whatever their number.
    """
    edge = bands.select(F.col(lo).cast("double").alias("_x"), F.struct(F.col(hi).alias("hi"), F.col(name).alias("name")).alias("_b"), F.lit(0).alias("_side"))
    rows = df.select(F.col(x).cast("double").alias("_x"), F.struct(*df.columns).alias("_row"), F.lit(1).alias("_side"))
    both = rows.unionByName(edge, allowMissingColumns=True)
    found = carry_last(both, [], lambda: value_slot(rows, "_x"), ["_x", "_side"], ["_b"]).where("_side = 1")
    return found.select("_row.*", F.when(F.col("_x") < F.col("_b.hi"), F.col("_b.name")).alias(name))


def point_in_time(labels: DataFrame, features: DataFrame, keys: list[str], label_ts: str, feature_ts: str, values: list[str]) -> DataFrame:
    """Latest feature at or before the label time; a later one would leak the outcome."""
    left = labels.withColumn("_lt", micros(label_ts))
    right = features.withColumn("_ft", micros(feature_ts))
    return asof(left, right, keys, "_lt", "_ft", [feature_ts, *values]).drop("_lt", "_ft")


def gate(df: DataFrame, passed: DataFrame, key: str) -> DataFrame:
    """Rows whose dataset passed its contract."""
    return df.join(passed, key, "left_semi")


def spend_per_signup(signups: DataFrame, spend: DataFrame, keys: list[str]) -> DataFrame:
    return signups.join(spend, keys, "left").withColumn("cost_per_signup", F.round(F.col("spend") / F.col("signups"), 6))


def missing(expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    return expected.join(present, keys, "left_anti")


def position_value(quantity: Column, price: Column) -> Column:
    return quantity * price
