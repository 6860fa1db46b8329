"""Cost records, budgets, gates and estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voltlake.functions.ordered import running_total
from voltlake.functions.quantiles import robust_z
from voltlake.functions.scalars import first_reason, lookup, r6, ratio

# Budget, ceilings and prices in GBP.
DAILY_BUDGET, TASK_CEILING = 150.0, 50.0
WARN_PCT, PAUSE_PCT, HALT_PCT = 80.0, 90.0, 100.0
PER_SECOND = {"ml.m5.xlarge": 0.28 / 3600, "ml.p3.2xlarge": 4.10 / 3600}
DEFAULT_PER_SECOND = 0.28 / 3600
DPU_PER_SECOND = 0.44 / 3600
PER_HOUR = {"ml.m5.xlarge": 0.28, "ml.m5.2xlarge": 0.56, "ml.p3.2xlarge": 4.10, "ml.p3.8xlarge": 16.40}
DEFAULT_PER_HOUR, FLAT_PER_HOUR, DBU_PRICE, DBUS_PER_NODE = 0.28, 0.30, 0.22, 0.75


def record(df: DataFrame, path: str) -> None:
    """Append typed cost rows, one folder per day."""
    typed = df.select("agent_name", "timestamp", "task_id", F.col("cost_gbp").cast("decimal(18,6)").alias("cost_gbp"), "resource_type", "metadata",
                      F.date_format("timestamp", "yyyyMMdd").alias("ds"))
    typed.write.mode("append").partitionBy("ds").parquet(path)


def agent_spend(log: DataFrame, start: str, end: str) -> DataFrame:
    d = lambda s: F.lit(s).cast("timestamp_ntz")
    return log.where((F.col("ts") >= d(start)) & (F.col("ts") <= d(end))).groupBy("agent").agg(F.sum("cost_gbp").cast("double").alias("spend"))


def daily_spend(log: DataFrame, *keys: str) -> DataFrame:
    return log.groupBy("ds", *keys).agg(F.sum("cost_gbp").alias("spend"))


def last_days(log: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    last = F.lit(as_of).cast("date")
    return daily_spend(log.where((F.col("ds") > F.date_sub(last, days)) & (F.col("ds") <= last)), "agent")


def breakdown(log: DataFrame, budget: float, top: int = 3) -> DataFrame:
    """Spend by agent and by resource type with the tail folded into ``other``, the share of the budget and the alert."""
    g = log.groupingSets([["agent"], ["resource_type"], []], "agent", "resource_type").agg(
        F.sum("cost_gbp").alias("spend"), F.grouping("agent").alias("ga"), F.grouping("resource_type").alias("gr"))
    kind = F.when((F.col("ga") == 1) & (F.col("gr") == 1), "total").when(F.col("ga") == 0, "agent").otherwise("resource_type")
    named = g.select(kind.alias("kind"), F.coalesce(F.col("agent").cast("string"), "resource_type", F.lit("all")).alias("name"), "spend")
    r = F.row_number().over(W.partitionBy("kind").orderBy(F.desc("spend"), "name"))  # one row per name
    folded = named.withColumn("name", F.when(r <= top, F.col("name")).otherwise("other")).groupBy("kind", "name").agg(F.sum("spend").cast("double").alias("spend"))
    use = F.max(F.when(F.col("kind") == "total", F.col("spend"))).over(W.partitionBy()) / F.lit(budget)
    return folded.select("kind", "name", "spend", r6(use).alias("budget_utilization"), F.when(use < 0.8, "ok").otherwise("warning").alias("alert_level"))


def forecast(log: DataFrame, start: str, days: int = 30, flat: float = 0.01) -> DataFrame:
    """Days x daily mean with a 95 % interval, and the sign of the daily trend relative to the mean."""
    daily = daily_spend(log).select(F.col("spend").cast("double").alias("y"), F.datediff("ds", F.lit(start).cast("date")).cast("double").alias("x"))
    m, sd, slope = F.avg("y"), F.stddev_samp("y"), F.regr_slope("y", "x")
    half = 1.96 * sd * days ** 0.5
    trend = F.when(ratio(slope, m) > flat, "rising").when(ratio(slope, m) < -flat, "falling").otherwise("stable")
    return daily.agg(F.lit(days).alias("forecast_days"), r6(m * days).alias("projected_total"), r6(m * days - half).alias("lo95"), r6(m * days + half).alias("hi95"), trend.alias("trend"))


def recommendations(log: DataFrame, idle_below: float, idle_share: float = 0.5, oversized_above: float = 100.0, oversized_share: float = 0.1) -> DataFrame:
    """Saving per resource type from idle (very cheap) and oversized (very dear) runs."""
    c = F.col("cost_gbp")
    g = log.groupBy("resource_type").agg(
        F.coalesce(F.sum(F.when(c < idle_below, c)), F.lit(0)).cast("double").alias("idle"),
        F.coalesce(F.sum(F.when(c > oversized_above, c)), F.lit(0)).cast("double").alias("big"))
    rows = F.array(F.struct(F.lit("scale down idle runs").alias("recommendation"), r6(F.col("idle") * idle_share).alias("potential_savings_gbp"), F.lit("medium").alias("priority")),
                   F.struct(F.lit("right-size dear runs").alias("recommendation"), r6(F.col("big") * oversized_share).alias("potential_savings_gbp"), F.lit("high").alias("priority")))
    return g.select(F.col("resource_type").alias("area"), F.inline(rows)).where("potential_savings_gbp > 0")


def anomalous(log: DataFrame, limit: float = 3.5) -> DataFrame:
    d = daily_spend(log, "agent").withColumn("spend", F.col("spend").cast("double"))
    return robust_z(d, ["agent"], "spend").where(F.abs("z") > limit).select("agent", "ds", "spend", r6("z").alias("z"))


def level(pct: Column) -> Column:
    """Alarm of a budget share in percent: the halt level includes its bound, the others do not."""
    return F.when(pct >= HALT_PCT, "P1_halt").when(pct > PAUSE_PCT, "P2_pause").when(pct > WARN_PCT, "P3_warn").otherwise("ok")


def hour_slot(ts: str) -> Column:
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(3_600_000_000))


def running_spend(log: DataFrame, order: list[str]) -> DataFrame:
    """Spend of the day so far, including the row; the day is cut into hours."""
    return running_total(log, ["ds"], hour_slot("ts"), order, {"spent": F.col("cost_gbp")})


def budget_levels(log: DataFrame, order: list[str], budget: float) -> DataFrame:
    """First row of each day at each alarm level."""
    pct = F.col("spent").cast("double") / F.lit(budget) * 100
    x = running_spend(log, order).withColumn("level", level(pct)).where("level <> 'ok'")
    keep = [c for c in order if c != "ts"]
    return x.groupBy("ds", "level").agg(F.min(F.struct(*order, "spent")).alias("f")).select("ds", "level", *[F.col(f"f.{c}").alias(c) for c in keep], F.col("f.spent").cast("double").alias("spent"))


def gate(spend: Column, estimate: Column, budget: float = DAILY_BUDGET, ceiling: float = TASK_CEILING) -> Column:
    """Reason a task may not run, or OK; the first failing check names it."""
    return first_reason([
        (spend >= budget, "Daily budget exceeded"),
        (estimate > ceiling, F.format_string("Task cost ceiling exceeded: £%.2f", estimate)),
        (spend + estimate > budget, F.format_string("Task would exceed daily budget: £%.2f + £%.2f > £%.2f", spend, estimate, F.lit(budget))),
    ], "OK")


def over_ceiling(log: DataFrame, name: str, ceilings: dict) -> DataFrame:
    c = lookup(F.col(name), ceilings).cast("double")
    return log.withColumn("ceiling", c).where(F.col("cost_gbp").cast("double") > F.col("ceiling"))


def attribution(log: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """Share of spend with a known owner. Spend is summed per key before the join."""
    s = log.groupBy(key).agg(F.sum("cost_gbp").alias("s")).join(owners.select(key, F.lit(1).alias("_o")), key, "left")
    known = F.sum(F.when(F.col("_o") == 1, F.col("s")))
    share = ratio(known, F.sum("s"))
    return s.agg(F.sum("s").cast("double").alias("spend"), known.cast("double").alias("attributed"), r6(share).alias("coverage"), (share >= 0.95).alias("met"))


def batch_estimate(records: Column, instance: Column) -> Column:
    return lookup(instance, PER_SECOND, DEFAULT_PER_SECOND) * F.greatest(F.lit(60.0), records / 1000 * 60)


def train_estimate(instance: Column, seconds: Column) -> Column:
    return lookup(instance, PER_SECOND, DEFAULT_PER_SECOND) * seconds


def etl_estimate(dpus: Column, seconds: Column) -> Column:
    return F.lit(DPU_PER_SECOND) * dpus * seconds


def job_cost(backend: Column, instance: Column, hours: Column, count: Column) -> Column:
    """Price per hour by backend: a table by instance type, a flat rate, or units per node."""
    price = (F.when(backend == "table", lookup(instance, PER_HOUR, DEFAULT_PER_HOUR)).when(backend == "flat", F.lit(FLAT_PER_HOUR))
             .otherwise(F.lit(DBU_PRICE * DBUS_PER_NODE)))
    return price * hours * count
