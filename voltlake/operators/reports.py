"""Report rows and insight texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlake.functions.scalars import r6


def importances(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Absolute correlation of each feature with the label, from one aggregate."""
    one = df.agg(*[F.abs(F.corr(F.col(f).cast("double"), F.col(label).cast("double"))).alias(f) for f in features])
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("importance")) for f in features])
    return one.select(F.inline(cells))


def top_driver(imp: DataFrame) -> DataFrame:
    return imp.agg(F.max_by("feature", "importance").alias("feature"), r6(F.max("importance")).alias("importance"))


def churn_summary(n, high, auc, cal):
    """Executive summary; texts are fixed formats."""
    return F.format_string(
        "Analyzed %,d customers with the daily churn forecast model. Identified %,d customers at high risk of churning in the next 30 days. "
        "Model performance: AUC %.3f, Calibration error %.3f.", n, high, auc, cal)


def churn_insights(one: DataFrame) -> DataFrame:
    """Numbered insight texts of a one-row frame with predictions_count, high_risk_count, feature, importance, auc."""
    pct = F.col("high_risk_count") / F.col("predictions_count") * 100
    driver = F.initcap(F.replace("feature", F.lit("_"), F.lit(" ")))
    texts = [
        F.format_string("🔴 %.1f%% of customers (%,d) are at high risk of churning", pct, "high_risk_count"),
        F.format_string("📊 Top churn driver: %s (%.0f%% importance)", driver, F.col("importance") * 100),
        F.when(F.col("auc") >= 0.80, F.format_string("✅ Model performance is strong (AUC: %.3f)", "auc")).otherwise(
            F.format_string("⚠️ Model performance needs attention (AUC: %.3f)", "auc")),
        F.lit("💡 Recommended action: Proactive outreach to high-risk customers with retention offers"),
    ]
    return one.select(F.posexplode(F.array(*texts)).alias("no", "insight"))


def drift_insights(one: DataFrame) -> DataFrame:
    texts = [
        F.format_string("Data drift detected in %d features", "features_with_drift"),
        F.format_string("Model performance dropped by %.1f%%", "auc_drop_pct"),
        F.format_string("Recommended action: %s", "action"),
    ]
    return one.select(F.posexplode(F.array(*texts)).alias("no", "insight"))


def performance_insights(one: DataFrame) -> DataFrame:
    texts = [F.format_string("AUC: %.3f", "auc"), F.format_string("Calibration error: %.3f", "calibration_error"), F.format_string("F1 Score: %.3f", "f1")]
    return one.select(F.posexplode(F.array(*texts)).alias("no", "insight"))


def side_by_side(*frames: DataFrame) -> DataFrame:
    """Join one-row results into one row."""
    out = frames[0].withColumn("_k", F.lit(1))
    for f in frames[1:]:
        out = out.join(F.broadcast(f.withColumn("_k", F.lit(1))), "_k")
    return out.drop("_k")


def what_changed(kpis: DataFrame, period: str, kpi: str, value: str) -> DataFrame:
    """Change of each KPI against the period before, ranked by size within the period. One row per KPI and period."""
    from pyspark.sql import Window as W

    prev = F.lag(value).over(W.partitionBy(kpi).orderBy(period))
    d = kpis.withColumn("delta", F.col(value) - prev).where(F.col("delta").isNotNull())
    return d.withColumn("delta", r6("delta")).withColumn("rank_no", F.row_number().over(W.partitionBy(period).orderBy(F.desc(F.abs("delta")), kpi)))


def partial_flag(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Expected series, which of them have data, and whether the report is partial."""
    have = actual.groupBy(*keys).agg(F.count("*").alias("points"))
    j = expected.join(have, keys, "left").withColumn("points", F.coalesce("points", F.lit(0)))
    return j.agg(F.count("*").alias("expected_series"), F.count_if(F.expr("points > 0")).alias("present_series"), (F.min("points") == 0).alias("partial"))


def persist(report: DataFrame, path: str, report_type: str, ds: str, run_id: str) -> None:
    """Write report rows as JSON under report type, day and run."""
    out = report.withColumns({"report_type": F.lit(report_type), "ds": F.lit(ds), "run_id": F.lit(run_id)})
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("report_type", "ds", "run_id").json(path)
