"""Portfolio risk, stress, hedging and backtests."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voltlake.functions.quantiles import percentiles
from voltlake.functions.scalars import r6

STRESS = {"price_crash": -0.40, "price_spike": 0.60, "cold_snap": 0.25, "mild_winter": -0.15, "supply_outage": 0.35, "demand_slump": -0.20}
HEDGE_RATIO = 0.8
HEDGE_SPLIT = {"futures": 0.7, "options": 0.3}


def value_at_risk(pnl: DataFrame, value: str = "pnl", level: float = 0.05) -> DataFrame:
    """Historical 95 % VaR, expected shortfall and volatility."""
    q = percentiles(pnl, [], value, {"q": level}).withColumn("_k", F.lit(1))
    j = pnl.where(F.col(value).isNotNull()).withColumn("_k", F.lit(1)).join(F.broadcast(q), "_k")  # one row
    return j.agg(r6(-F.max("q")).alias("var_95"), r6(-F.avg(F.when(F.col(value) <= F.col("q"), F.col(value)))).alias("expected_shortfall"),
                 r6(F.stddev_samp(value)).alias("volatility"), F.count("*").alias("days"))


def monte_carlo(positions: DataFrame, instrument: str, exposure: str, paths: int = 10_000, daily_vol: float = 0.02, seed: int = 11) -> DataFrame:
    """Simulated one-day P&L: exposures are summed per instrument, each instrument is expanded into its paths, and paths are summed.

    A path's move of an instrument is a normal number made of a hash of both (Box and Muller), so it does not depend on
    partitioning. Moves are added as decimals.
    """
    held = positions.groupBy(instrument).agg(F.sum(exposure).alias(exposure))
    sims = held.select(exposure, F.explode(F.sequence(F.lit(1), F.lit(paths))).alias("path"), F.col(instrument).alias("_i"))
    sims = sims.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_i").cast("string"), F.col("path").cast("string"))))
    u = lambda at: (F.conv(F.substring("_h", at, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    normal = F.sqrt(-2 * F.log(u(1))) * F.cos(2 * math.pi * u(13))
    pnl = sims.groupBy("path").agg(F.sum((F.col(exposure) * daily_vol * normal).cast("decimal(24,4)")).cast("double").alias("pnl"))
    return value_at_risk(pnl).withColumnRenamed("days", "paths")


def stress(positions: DataFrame, exposure: str, scenarios: dict[str, float] | None = None) -> DataFrame:
    from voltlake.operators.joins import with_scenarios

    t = with_scenarios(positions.agg(F.sum(exposure).alias("total")), scenarios or STRESS)
    return t.select("scenario", r6(F.col("total") * (1 + F.col("factor"))).alias("value"), r6(F.col("total") * F.col("factor")).alias("pnl"))


def hedges(positions: DataFrame, instrument: str, exposure: str, ratio: float = HEDGE_RATIO, split: dict[str, float] | None = None) -> DataFrame:
    legs = F.array(*[F.struct(F.lit(k).alias("leg"), F.lit(v).alias("w")) for k, v in (split or HEDGE_SPLIT).items()])
    return positions.select(instrument, exposure, F.inline(legs)).select(
        instrument, "leg", r6(F.col(exposure) * F.lit(ratio) * F.col("w")).alias("volume"))


def backtest(pnl: DataFrame, date: str, days: int, level: float = 0.05) -> DataFrame:
    """Share of days whose loss stays within the VaR of the days before. The input has one row per day."""
    w = W.orderBy(date).rowsBetween(-days, -1)
    x = pnl.where("pnl is not null").select("pnl", F.percentile("pnl", F.lit(level)).over(w).alias("q"), F.count("*").over(w).alias("c")).where(F.col("c") == days)
    bad = F.count_if(F.col("pnl") < F.col("q"))
    return x.agg(F.count("*").alias("days"), bad.alias("exceedances"), r6(1 - bad / F.count("*")).alias("var_accuracy"), (1 - bad / F.count("*") >= 0.95).alias("passed"))


def large_exposures(positions: DataFrame, exposure: str, limit: float) -> DataFrame:
    return positions.where(F.abs(exposure) > limit)


def price_state(age_hours: Column, live_hours: float = 1.0, cached_hours: float = 4.0) -> Column:
    return F.when(age_hours <= live_hours, "live").when(age_hours <= cached_hours, "cached").otherwise("stale")
