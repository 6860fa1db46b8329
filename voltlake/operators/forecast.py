"""Daily forecasts: recent level times weekday factor, with intervals and backtests.

All series are reduced to one row per key and day first; every later step works on those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlake.functions.scalars import r6, ratio

WINDOW_DAYS = 28
Z95 = 1.96
Z_LEVELS = {0.5: 0.674490, 0.8: 1.281552, 0.9: 1.644854, 0.95: 1.959964}


def daily_counts(df: DataFrame, keys: list[str], ts: str, value=None) -> DataFrame:
    y = F.count("*") if value is None else F.sum(value)
    return df.groupBy(*keys, F.col(ts).cast("date").alias("ds")).agg(y.cast("double").alias("y"))


def recent(series: DataFrame, keys: list[str], as_of: str, days: int = WINDOW_DAYS) -> DataFrame:
    """The last ``days`` days of each series; days without rows count 0."""
    last = F.lit(as_of).cast("date")
    inside = series.where((F.col("ds") > F.date_sub(last, days)) & (F.col("ds") <= last))
    zero = inside.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("ds"), F.lit(0.0).alias("y"))
    return inside.select(*keys, "ds", "y").unionByName(zero).groupBy(*keys, "ds").agg(F.sum("y").alias("y"))


def model(series: DataFrame, keys: list[str], as_of: str, days: int = WINDOW_DAYS) -> DataFrame:
    """Per key: level, map of weekday factors and standard deviation of the residuals. One row per series."""
    h = recent(series, keys, as_of, days).withColumn("wd", F.weekday("ds"))
    by_wd = h.groupBy(*keys, "wd").agg(F.avg("y").alias("m"), F.count("*").alias("c"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q"))
    g = by_wd.groupBy(*keys).agg(
        (F.sum("s") / F.sum("c")).alias("level"), F.map_from_entries(F.collect_list(F.struct("wd", "m"))).alias("weekday"),
        # residual = y - weekday mean; its mean is 0
        F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("q") - F.col("s") * F.col("m"))) / (F.sum("c") - 1)).alias("sd"))
    factor = F.transform_values("weekday", lambda _, m: F.when(F.col("level") > 0, m / F.col("level")).otherwise(0.0))
    return g.select(*keys, "level", factor.alias("factor"), "sd")


def predict(m: DataFrame, keys: list[str], as_of: str, horizon: int) -> DataFrame:
    """One row per key and day of the horizon."""
    days = F.explode(F.sequence(F.date_add(F.lit(as_of).cast("date"), 1), F.date_add(F.lit(as_of).cast("date"), horizon)))
    f = m.withColumn("ds", days)
    return f.select(*keys, "ds", (F.col("level") * F.col("factor")[F.weekday("ds")]).alias("yhat"), "sd")


def total(forecast: DataFrame, keys: list[str], horizon: int) -> DataFrame:
    width = F.lit(Z95) * F.max("sd") * F.lit(float(horizon) ** 0.5)
    s = F.sum("yhat")
    return forecast.groupBy(*keys).agg(
        F.round(s, 4).alias("total"), F.round(F.max("yhat"), 4).alias("peak"), F.round(s - width, 4).alias("lo95"), F.round(s + width, 4).alias("hi95"))


def with_actuals(forecast: DataFrame, series: DataFrame, keys: list[str]) -> DataFrame:
    """Forecast beside the actual value and the naive one, the actual of the same weekday a week before."""
    a = series.select(*keys, "ds", "y")
    n = series.select(*keys, F.date_add("ds", 7).alias("ds"), F.col("y").alias("naive"))
    return forecast.join(a, [*keys, "ds"]).join(n, [*keys, "ds"], "left")


def metrics(bt: DataFrame, keys: list[str]) -> DataFrame:
    e = F.col("yhat") - F.col("y")
    mae, naive = F.avg(F.abs(e)), F.avg(F.abs(F.col("naive") - F.col("y")))
    inside = F.abs(e) <= F.lit(Z_LEVELS[0.8]) * F.col("sd")
    return bt.groupBy(*keys).agg(
        F.count("*").alias("n"), r6(mae).alias("mae"), r6(F.sqrt(F.avg(e * e))).alias("rmse"),
        r6(F.avg(F.when(F.col("y") != 0, F.abs(e / F.col("y"))))).alias("mape"), r6(ratio(F.sum(e), F.sum("y"))).alias("bias"),
        r6(F.avg(F.when(inside, 1.0).otherwise(0.0))).alias("coverage_80"), r6(F.avg(0.5 * F.abs(e))).alias("pinball_50"),
        r6(1 - ratio(mae, naive)).alias("skill"))


def fallback(forecast: DataFrame, series: DataFrame, keys: list[str], as_of: str) -> DataFrame:
    """Missing forecasts become the last known value of the weekday, else the recent mean; the origin is named."""
    last = F.lit(as_of).cast("date")
    known = series.where(F.col("ds") <= last)
    wd = known.groupBy(*keys, F.weekday("ds").alias("wd")).agg(F.max_by("y", "ds").alias("last_wd"))
    mean = recent(series, keys, as_of).groupBy(*keys).agg(F.avg("y").alias("mean"))
    on = [*keys, "wd"]
    j = forecast.withColumn("wd", F.weekday("ds")).join(wd, on, "left")
    j = j.withColumn("_k", F.lit(1)).join(mean.withColumn("_k", F.lit(1)), [*keys, "_k"], "left")
    origin = F.when(F.col("yhat").isNotNull(), "model").when(F.col("last_wd").isNotNull(), "weekday").otherwise("mean")
    return j.select(*keys, "ds", F.coalesce("yhat", "last_wd", "mean").alias("yhat"), origin.alias("origin"))


def calibration(bt: DataFrame) -> DataFrame:
    """Observed coverage of each nominal interval level."""
    levels = F.array(*[F.struct(F.lit(k).alias("level"), F.lit(z).alias("z")) for k, z in Z_LEVELS.items()])
    x = bt.select("y", "yhat", "sd", F.inline(levels))
    return x.groupBy("level").agg(r6(F.avg(F.when(F.abs(F.col("yhat") - F.col("y")) <= F.col("z") * F.col("sd"), 1.0).otherwise(0.0))).alias("coverage"), F.count("*").alias("n"))


def funnel(df: DataFrame, channel, kind: str, value: str) -> DataFrame:
    n = lambda k: F.count_if(F.col(kind) == k)
    spend = F.sum(F.when(F.col(kind) == "click", F.col(value).cast("decimal(18,2)"))).cast("double")
    return df.groupBy(channel.alias("channel")).agg(
        n("view").alias("views"), n("click").alias("clicks"), n("signup").alias("signups"), n("purchase").alias("purchases"),
        r6(n("signup") / F.nullif(n("view"), F.lit(0))).alias("conversion"), r6(spend / F.nullif(n("signup"), F.lit(0))).alias("spend_per_signup"))
