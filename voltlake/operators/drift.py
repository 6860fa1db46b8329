"""Drift detection over feature tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltlake.functions.ordered import running_total, value_slot
from voltlake.functions.quantiles import percentiles
from voltlake.functions.scalars import lookup, r6, ratio

# Thresholds (all exceeded strictly), severities, actions and alert levels.
PSI_LIMIT, KS_LIMIT, PERFORMANCE_LIMIT = 0.2, 0.3, 0.10
TREND_LIMIT, SHIFT_LIMIT = 0.05, 0.10
HIGH_FEATURES, HIGH_DROP_PCT, MEDIUM_DROP_PCT = 5, 10.0, 5.0
ALERTS = {"emergency_retrain": "P1", "trigger_retrain": "P2"}
FLOOR = 1e-6


def long_form(df: DataFrame, features: list[str], *keep: str) -> DataFrame:
    """One row per (row, feature)."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])
    return df.select(*keep, F.inline(cells)).where(F.col("x").isNotNull())


def psi(df: DataFrame, features: list[str], current: Column) -> DataFrame:
    """Population Stability Index per feature between reference rows and current rows of one frame."""
    both = long_form(df.withColumn("cur", current.cast("int")), features, "cur")
    probs = {f"c{i}": i / 10 for i in range(1, 10)}
    cuts = percentiles(both.where("cur = 0"), ["feature"], "x", probs)
    # one row per feature of a declared schema, so the cut points are small whatever the row count
    j = both.join(F.broadcast(cuts), "feature", "left")
    bin_ = sum((F.col("x") > F.col(c)).cast("int") for c in probs)
    shares = j.groupBy("feature", F.coalesce(bin_, F.lit(-1)).alias("bin")).agg(F.count_if(F.expr("cur = 0")).alias("r"), F.count_if(F.expr("cur = 1")).alias("c"))
    wide = shares.groupBy("feature").agg(F.sum("r").alias("rs"), F.sum("c").alias("cs"), F.map_from_entries(F.collect_list(F.struct("bin", F.struct("r", "c")))).alias("m"))

    def term(i):
        cell = F.col("m")[i]
        p = F.greatest(F.coalesce(cell["r"], F.lit(0)) / F.nullif("rs", F.lit(0)), F.lit(FLOOR))
        q = F.greatest(F.coalesce(cell["c"], F.lit(0)) / F.nullif("cs", F.lit(0)), F.lit(FLOOR))
        return (q - p) * F.log(q / p)

    value = F.when((F.col("rs") > 0) & (F.col("cs") > 0), sum((term(i) for i in range(10)), F.lit(0.0)))  # null without rows on a side
    return wide.select("feature", r6(value).alias("psi"), (value > PSI_LIMIT).alias("drift"))


def ks(df: DataFrame, features: list[str], current: Column) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance per feature, with its asymptotic significance."""
    both = long_form(df.withColumn("cur", current.cast("int")), features, "cur")
    g = both.groupBy("feature", "x").agg(F.count_if(F.expr("cur = 0")).alias("r"), F.count_if(F.expr("cur = 1")).alias("c"))
    run = running_total(g, ["feature"], lambda: value_slot(both, "x"), ["x"], {"cr": F.col("r"), "cc": F.col("c")}, whole=True)
    d = F.max(F.abs(ratio("cr", "cr_all") - ratio("cc", "cc_all")))
    t = run.groupBy("feature").agg(d.alias("d"), F.max("cr_all").alias("n"), F.max("cc_all").alias("m"))
    lam = F.col("d") * F.sqrt(ratio(F.col("n") * F.col("m"), F.col("n") + F.col("m")))
    series = sum(((-1) ** (k - 1) * F.exp(-2.0 * k * k * lam * lam) for k in range(1, 6)), F.lit(0.0))
    p = F.when(F.col("d").isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2.0 * series)))
    return t.select("feature", r6("d").alias("ks"), (F.col("d") > KS_LIMIT).alias("drift"), r6(p).alias("p_value"))


def data_severity(n: Column) -> Column:
    return F.when(n > HIGH_FEATURES, "high").when(n > 0, "medium").otherwise("none")


def data_summary(psi_rows: DataFrame) -> DataFrame:
    n = F.count_if("drift")
    return psi_rows.agg(
        (n > 0).alias("drift_detected"), F.count("*").alias("features_analyzed"), n.alias("features_with_drift"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("drift"), F.col("feature")))), ",").alias("drift_features"),
        F.max("psi").alias("max_psi"), r6(F.avg("psi")).alias("mean_psi"), data_severity(n).alias("drift_severity"))


def model_severity(drop_pct: Column) -> Column:
    return F.when(drop_pct > HIGH_DROP_PCT, "high").when(drop_pct > MEDIUM_DROP_PCT, "medium").otherwise("none")


def model_drift(metrics: DataFrame, period: str = "period") -> DataFrame:
    """Compare the rows ``baseline`` and ``current`` of a metrics table with auc and calibration_error."""
    at = lambda p, c: F.max(F.when(F.col(period) == p, F.col(c)))
    g = metrics.agg(*[at(p, c).alias(f"{p}_{c}") for p in ("baseline", "current") for c in ("auc", "calibration_error")])
    drop = ratio(F.col("baseline_auc") - F.col("current_auc"), "baseline_auc") * 100
    return g.select("*", r6(drop).alias("auc_drop_pct"), (drop > PERFORMANCE_LIMIT * 100).alias("drift_detected"), model_severity(drop).alias("drift_severity"))


def residual_trend(daily: DataFrame, day_no: str, residual: str) -> Column:
    """Change of the mean absolute residual over the period, relative to its mean; ``daily`` has one row per day."""
    return F.regr_slope(F.col(residual), F.col(day_no).cast("double")) * F.count("*") / F.avg(residual)


def importance_shift(a: DataFrame, b: DataFrame) -> DataFrame:
    """Half the L1 distance of two normalised importance tables; one row per feature on each side."""
    def shares(d, n):
        return d.select("feature", F.col("importance").alias(n), F.lit(1).alias("_k"))
    j = shares(a, "a").join(shares(b, "b").drop("_k"), "feature", "full_outer")
    s = j.agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"), F.collect_list(F.struct(F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"))).alias("r"))
    gap = F.aggregate("r", F.lit(0.0), lambda acc, r: acc + F.abs(F.try_divide(r["a"], F.col("sa")) - F.try_divide(r["b"], F.col("sb"))))
    return s.select((0.5 * gap).alias("shift"))


def concept_verdict(trend: Column, shift: Column) -> tuple[Column, Column]:
    hit = (trend > TREND_LIMIT) | (shift > SHIFT_LIMIT)
    return hit, F.when(hit, "high").otherwise("none")


def action(data: Column, model: Column, concept: Column, concept_drift: Column) -> Column:
    high = (data == "high") | (model == "high") | (concept == "high")
    medium = (data == "medium") | (model == "medium") | (concept == "medium")
    return (F.when(high & concept_drift, "emergency_retrain").when(high, "trigger_retrain")
            .when(medium, "schedule_review").otherwise("monitor"))


def alert(act: Column) -> Column:
    return lookup(act, ALERTS, "P3")
