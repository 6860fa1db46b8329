"""Trial design and analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltlake.functions.scalars import normal_cdf, r6, ratio

Z_ALPHA, Z_POWER, ALPHA, MIN_POWER = 1.959964, 0.841621, 0.05, 0.80


def sample_size(baseline: Column, mde: float) -> Column:
    """Units per arm for an absolute effect at 5 % significance and 80 % power."""
    return F.ceil(2 * baseline * (1 - baseline) * (Z_ALPHA + Z_POWER) ** 2 / mde ** 2)


def design(units: DataFrame, group: str, hit: str, date: str, mde: float = 0.05, variants: int = 2) -> DataFrame:
    g = units.groupBy(group).agg(F.avg(hit).alias("p"), F.count("*").alias("n"), F.countDistinct(date).alias("d"))
    size = sample_size(F.col("p"), mde)
    return g.select(group, r6("p").alias("baseline"), size.cast("long").alias("sample_per_variant"),
                    F.ceil(size * variants / (F.col("n") / F.col("d"))).cast("long").alias("duration_days"))


def assign(key: Column, variants: list[str], prime: int = 7919) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in variants]), (F.pmod(key * prime, F.lit(len(variants))) + 1).cast("int"))


def arm_rates(units: DataFrame, arm: str, hit: str, keys: list[str] | None = None) -> DataFrame:
    return units.groupBy(*(keys or []), arm).agg(F.count("*").alias("n"), F.sum(hit).alias("x"), F.avg(hit).alias("p"))


def against_control(rates: DataFrame, arm: str, control, keys: list[str] | None = None) -> DataFrame:
    """Each other arm beside the control arm; a handful of rows per key."""
    keys = keys or []
    c = rates.where(F.col(arm) == control).select(*keys, F.lit(1).alias("_k"), F.col("n").alias("n0"), F.col("x").alias("x0"), F.col("p").alias("p0"))
    return rates.where(F.col(arm) != control).withColumn("_k", F.lit(1)).join(c, [*keys, "_k"]).drop("_k")


def analyse(units: DataFrame, arm: str, hit: str, control) -> DataFrame:
    """Two-proportion test of each arm against control: lift, p-value, interval and winner."""
    j = against_control(arm_rates(units, arm, hit), arm, control)
    pool = (F.col("x") + F.col("x0")) / (F.col("n") + F.col("n0"))
    diff = F.col("p") - F.col("p0")
    z = ratio(diff, F.sqrt(pool * (1 - pool) * (1 / F.col("n") + 1 / F.col("n0"))))
    pval = 2 * (1 - normal_cdf(F.abs(z)))
    half = Z_ALPHA * F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n") + F.col("p0") * (1 - F.col("p0")) / F.col("n0"))
    win = F.when(pval < ALPHA, F.when(diff > 0, F.col(arm).cast("string")).otherwise(F.lit(str(control)))).otherwise("none")
    return j.select(arm, r6("p0").alias("control_rate"), r6("p").alias("rate"), r6(ratio(diff, "p0")).alias("lift"), r6(z).alias("z"), r6(pval).alias("p_value"),
                    r6(diff - half).alias("ci_low"), r6(diff + half).alias("ci_high"), win.alias("winner"))


def power(units: DataFrame, arm: str, hit: str, control) -> DataFrame:
    j = against_control(arm_rates(units, arm, hit), arm, control)
    se = F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n") + F.col("p0") * (1 - F.col("p0")) / F.col("n0"))
    pw = normal_cdf(ratio(F.abs(F.col("p") - F.col("p0")), se) - Z_ALPHA)
    return j.select(arm, r6(pw).alias("power"), (pw >= MIN_POWER).alias("enough"))


def balance(df: DataFrame, arm: str, covariates: list[str], control) -> DataFrame:
    """Standardised mean difference of each covariate between each arm and control."""
    cells = F.array(*[F.struct(F.lit(c).alias("covariate"), F.col(c).cast("double").alias("v")) for c in covariates])
    g = df.select(arm, F.inline(cells)).groupBy("covariate", arm).agg(F.avg("v").alias("m"), F.var_samp("v").alias("s"))
    c = g.where(F.col(arm) == control).select("covariate", F.col("m").alias("m0"), F.col("s").alias("s0"))
    j = g.where(F.col(arm) != control).join(c, "covariate")
    return j.select("covariate", arm, r6(ratio(F.col("m") - F.col("m0"), F.sqrt((F.col("s") + F.col("s0")) / 2))).alias("smd"))


def stratified_effect(df: DataFrame, stratum: str, treated: str, outcome: str) -> DataFrame:
    """Effect by inverse weighting with the treated share of each stratum as propensity."""
    g = df.groupBy(stratum).agg(
        F.count("*").alias("n"), F.sum(treated).alias("t"), F.sum(F.col(treated) * F.col(outcome)).alias("yt"), F.sum((1 - F.col(treated)) * F.col(outcome)).alias("yc"))
    g = g.where((F.col("t") > 0) & (F.col("t") < F.col("n")))
    e = F.col("t") / F.col("n")
    return g.agg(F.sum("n").alias("units"), r6(F.sum(F.col("yt") / e) / F.sum("n")).alias("treated_rate"), r6(F.sum(F.col("yc") / (1 - e)) / F.sum("n")).alias("control_rate"),
                 r6((F.sum(F.col("yt") / e) - F.sum(F.col("yc") / (1 - e))) / F.sum("n")).alias("effect"))


def propensity_effect(df: DataFrame, covariates: list[str], treated: str, outcome: str) -> DataFrame:
    """Effect by inverse weighting with a fitted logistic propensity, kept within 0.01 and 0.99."""
    from voltlake.operators.models import pipeline, predict, stored

    data = df.select(treated, outcome, *[F.col(c).cast("double").alias(c) for c in covariates])
    scored = predict(stored(pipeline(covariates, treated).fit(data), df.sparkSession), data, "propensity")
    e = F.least(F.greatest(F.col("propensity"), F.lit(0.01)), F.lit(0.99))
    wt, wc = F.col(treated) / e, (1 - F.col(treated)) / (1 - e)
    y = F.col(outcome)
    return scored.agg(F.count("*").alias("units"), (ratio(F.sum(wt * y), F.sum(wt)) - ratio(F.sum(wc * y), F.sum(wc))).alias("effect"))


def uplift(units: DataFrame, stratum: str, arm: str, hit: str, control) -> DataFrame:
    j = against_control(arm_rates(units, arm, hit, [stratum]), arm, control, [stratum])
    return j.select(stratum, arm, "n", "n0", r6(F.col("p") - F.col("p0")).alias("uplift"))


def canary(df: DataFrame, key: Column, share_of_ten: int, metrics: dict[str, Column], prime: int = 7919) -> DataFrame:
    """Means of canary and production rows side by side; the split is a stable function of the key."""
    side = F.when(F.pmod(key * prime, F.lit(10)) < share_of_ten, "canary").otherwise("production")
    g = df.groupBy(side.alias("side")).agg(F.count("*").alias("n"), *[F.avg(c).alias(n) for n, c in metrics.items()])
    at = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    out = g.agg(*[at(s, c).alias(f"{s}_{c}") for s in ("canary", "production") for c in ("n", *metrics)])
    return out.select(*[r6(c).alias(c) if not c.endswith("_n") else F.col(c) for c in out.columns],
                      *[r6(ratio(f"canary_{m}", f"production_{m}") - 1).alias(f"{m}_change") for m in metrics])

