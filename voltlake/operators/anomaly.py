"""Anomalies and fraud indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlake.functions.quantiles import robust_z
from voltlake.functions.scalars import r6, ratio

Z_LIMIT = 3.5
# Precision, recall and false-positive targets of a detector.
MIN_PRECISION, MIN_RECALL, MAX_FPR = 0.70, 0.85, 0.05


def usage_anomalies(df: DataFrame, keys: list[str], value: str, limit: float = Z_LIMIT) -> DataFrame:
    z = robust_z(df, keys, value).where(F.abs("z") > limit)
    return z.select(*df.columns, r6(1 - F.exp(-F.abs("z") / 3.0)).alias("anomaly_score"), F.when(F.col("z") > 0, "spike").otherwise("drop").alias("type"))


def fraud_cases(lines: DataFrame, account: str, min_score: float) -> DataFrame:
    """Accounts with their worst line score, number of cases and the indicators seen in cases."""
    flags = {"high_discount": F.col("l_discount") >= 0.10, "bulk_quantity": F.col("l_quantity") >= 50, "returned": F.col("l_returnflag") == "R"}
    score = sum((c.cast("int") for c in flags.values()), F.lit(0)) / F.lit(float(len(flags)))
    s = lines.select(account, score.alias("s"), *[c.alias(n) for n, c in flags.items()]).where(F.col("s") >= min_score)
    g = s.groupBy(account).agg(F.max("s").alias("s"), F.count("*").alias("cases"), *[F.max(n).alias(n) for n in flags])
    return g.select(F.col(account).alias("account_id"), r6("s").alias("fraud_score"), "cases",
                    F.array_compact(F.array(*[F.when(F.col(n), n) for n in flags])).alias("indicators"))


def tune_threshold(df: DataFrame, score: str, label: str) -> DataFrame:
    """Threshold that meets all targets with the best F1; without one, the best F1 and ``feasible`` false."""
    from voltlake.operators.metrics import _by_score

    g = _by_score(df, [], score, label, descending=True)
    p, r = ratio("cum_pos", F.col("cum_pos") + F.col("cum_neg")), ratio("cum_pos", "cum_pos_all")
    fpr = ratio("cum_neg", "cum_neg_all")
    x = g.select(r6(-F.col("_s")).alias("threshold"), r6(p).alias("precision"), r6(r).alias("recall"), r6(fpr).alias("false_positive_rate"),
                 r6(ratio(2 * F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg") + F.col("cum_pos_all"))).alias("f1"))
    ok = (F.col("precision") >= MIN_PRECISION) & (F.col("recall") >= MIN_RECALL) & (F.col("false_positive_rate") <= MAX_FPR)
    x = x.withColumn("feasible", ok)
    return x.agg(F.max(F.struct("feasible", "f1", "threshold", "precision", "recall", "false_positive_rate")).alias("b")).select("b.*")
