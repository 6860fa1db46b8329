"""Keyed tables: lookup, upsert, partial update and query by key condition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def get(table: DataFrame, key: dict) -> DataFrame:
    """The row of a key, or none; the equality filter reaches the scan."""
    cond = F.lit(True)
    for k, v in key.items():
        cond = cond & (F.col(k) == F.lit(v))
    return table.where(cond)


def put(table: DataFrame, items: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Upsert of whole rows. An item replaces the stored row; among items of one key the highest version wins."""
    rest = [c for c in table.columns if c not in keys]
    old = table.select(*keys, F.struct(F.lit(0).alias("new"), F.lit(None).cast("long").alias("v"), *rest).alias("r"))
    new = items.select(*keys, F.struct(F.lit(1).alias("new"), F.col(version).cast("long").alias("v"), *rest).alias("r"))
    best = old.unionByName(new).groupBy(*keys).agg(F.max("r").alias("r"))
    return best.select(*[F.col(c) if c in keys else F.col(f"r.{c}") for c in table.columns])


def update(table: DataFrame, changes: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Set fields of rows, creating missing ones. ``changes`` has ``<field>`` and ``<field>_set``; a null that is set wins."""
    c = changes.select(*keys, *[F.col(f).alias(f"_n_{f}") for f in fields], *[F.col(f"{f}_set").alias(f"_s_{f}") for f in fields])
    j = table.join(c, keys, "full_outer")
    value = lambda f: F.when(F.coalesce(f"_s_{f}", F.lit(False)), F.col(f"_n_{f}")).otherwise(F.col(f)).alias(f)
    return j.select(*[value(f) if f in fields else F.col(f) for f in table.columns])


def query(table: DataFrame, condition: Column, order_key: str, limit: int | None = None, after=None) -> DataFrame:
    """Rows of a key condition in the order of the range key or of another index: all, or ``limit`` rows behind ``after``."""
    rows = table.where(condition if after is None else condition & (F.col(order_key) > F.lit(after))).orderBy(order_key)
    return rows if limit is None else rows.limit(limit)
