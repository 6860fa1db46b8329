"""Feature store: definitions, computation, online and offline stores, validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltlake.functions.ordered import running_total
from voltlake.functions.scalars import money, r6, ratio
from voltlake.operators.joins import enrich_geography, full_parity

# The customer feature group and the type names it is declared with.
CUSTOMER_GROUP = {
    "customer_id": "String", "event_time": "String", "age": "Integral", "tenure_days": "Integral",
    "lifetime_value": "Fractional", "last_purchase_days": "Integral", "avg_monthly_spend": "Fractional",
    "num_support_tickets": "Integral", "region": "String", "plan_type": "String",
}
TYPES = {"String": T.StringType(), "Integral": T.LongType(), "Fractional": T.DoubleType()}
MAX_AGE_HOURS, MIN_COMPLETE, MIN_PARITY, CONTRACT_PARITY = 1.0, 0.99, 0.99, 0.999


def group_schema(definition: dict[str, str]) -> T.StructType:
    return T.StructType([T.StructField(n, TYPES[k], n not in ("customer_id", "event_time")) for n, k in definition.items()])


def conform(df: DataFrame, definition: dict[str, str]) -> DataFrame:
    """Columns of a group in order and in the declared types."""
    return df.select(*[F.col(n).cast(TYPES[k]).alias(n) for n, k in definition.items()])


def customer_features(customers: DataFrame, orders: DataFrame, events: DataFrame, nation: DataFrame, region: DataFrame, as_of: str) -> DataFrame:
    """The customer group; orders and events are reduced to one row per customer before they meet the customers."""
    day = F.lit(as_of).cast("date")
    past = orders.where(F.col("o_orderdate") <= F.lit(as_of).cast("timestamp_ntz"))
    o = past.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.sum(money("o_totalprice")).alias("spend"), F.min("o_orderdate").cast("date").alias("first"), F.max("o_orderdate").cast("date").alias("last"))
    tickets = events.where("event_type = 'error'").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("tickets"))
    months = F.greatest(F.lit(1), F.floor(F.months_between(day, F.col("first"))).cast("int"))
    j = enrich_geography(customers, nation, region, "c_nationkey").join(o, "c_custkey", "left").join(tickets, "c_custkey", "left")
    return j.select(
        F.col("c_custkey").cast("string").alias("customer_id"), F.lit(as_of).alias("event_time"),
        (18 + F.col("c_custkey") % 70).alias("age"), F.datediff(day, "first").alias("tenure_days"),
        F.col("spend").cast("double").alias("lifetime_value"), F.datediff(day, "last").alias("last_purchase_days"),
        F.round(F.col("spend").cast("double") / months, 4).alias("avg_monthly_spend"),
        F.coalesce("tickets", F.lit(0)).alias("num_support_tickets"), F.col("r_name").alias("region"), F.col("c_mktsegment").alias("plan_type"))


def online(offline: DataFrame, key: str, event_time: str) -> DataFrame:
    """Latest row per key of the history."""
    rest = [c for c in offline.columns if c not in (key, event_time)]
    return offline.groupBy(key).agg(F.max(F.struct(event_time, *rest)).alias("r")).select(key, "r.*")


def backfill(daily: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Running features as they stood at the end of each day of an inclusive range, for every key seen by then.

    All days come from one job: rows before the range are folded into its first day, the range is filled per key.
    """
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    seen = daily.where(F.col("ds") <= last).withColumn("ds", F.greatest("ds", first))
    facts = seen.groupBy(key, "ds").agg(F.sum("n_events").alias("n"), F.sum("total").alias("v"))
    born = facts.groupBy(key).agg(F.min("ds").alias("born"))
    blank = born.select(key, F.explode(F.sequence("born", last)).alias("ds"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("decimal(28,2)").alias("v"))
    dense = facts.select(key, "ds", "n", F.col("v").cast("decimal(28,2)").alias("v")).unionByName(blank).groupBy(key, "ds").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    run = running_total(dense, [key], F.date_format("ds", "yyyyMM").cast("int"), ["ds"], {"n_events": F.col("n"), "total": F.col("v")})  # at most one row per day and key
    return run.select(key, "ds", "n_events", "total")


def only(store: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return store.join(ids, key, "left_semi")


def parity(offline: DataFrame, online_: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Share of (key, feature) cells equal in both stores."""
    j = full_parity(offline, online_, keys, features)
    equal = reduce(lambda a, b: a + b, [F.count_if(f"{c}_equal") for c in features])
    s = ratio(equal, F.count("*") * len(features))
    return j.agg(F.count("*").alias("keys"), r6(s).alias("parity"), (s >= MIN_PARITY).alias("passed"), (s >= CONTRACT_PARITY).alias("contract_passed"))


def freshness(df: DataFrame, event_time: str, as_of: str) -> DataFrame:
    h = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.max(event_time).cast("timestamp"))) / F.lit(3.6e9)
    return df.agg(r6(h).alias("hours"), (h <= MAX_AGE_HOURS).alias("passed"))


def completeness(df: DataFrame, features: list[str]) -> DataFrame:
    nulls = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in features])
    s = 1 - ratio(nulls, F.count("*") * len(features))
    return df.agg(r6(s).alias("completeness"), (s >= MIN_COMPLETE).alias("passed"))


def validation(checks: dict[str, DataFrame]) -> DataFrame:
    """One row: each check's verdict and their conjunction. The inputs are one-row frames with a ``passed`` column."""
    rows = reduce(DataFrame.unionByName, [d.select(F.lit(n).alias("check"), "passed") for n, d in checks.items()])
    return rows.agg(*[F.max(F.when(F.col("check") == n, F.col("passed"))).alias(f"{n}_passed") for n in checks], F.min("passed").alias("valid"))


def with_fallback(ids: DataFrame, fresh: DataFrame, cached: DataFrame, key: str, value: str, cached_at: str, as_of: str, max_hours: float = 24.0) -> DataFrame:
    """New value, else the cached one if not too old, else null with its origin named."""
    age = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col(cached_at).cast("timestamp"))) / F.lit(3.6e9)
    c = cached.select(key, F.col(value).alias("_c"), age.alias("_age"))
    j = ids.join(fresh.select(key, F.col(value).alias("_n")), key, "left").join(c, key, "left")
    usable = F.when(F.col("_age") <= max_hours, F.col("_c"))
    origin = F.when(F.col("_n").isNotNull(), "new").when(usable.isNotNull(), "cached").otherwise("missing")
    return j.select(key, F.coalesce("_n", usable).alias(value), origin.alias("origin"))
