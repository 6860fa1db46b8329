"""Policy checks on data: minimisation, retention, lawful basis, erasure, safe paths, anonymity, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltlake.functions.scalars import lookup, share

# The retention policy in days, its default, the lawful purposes and the closed enumerations.
MAX_RETENTION_DAYS = {"customer_data": 2555, "transaction_data": 2555, "model_predictions": 365, "audit_logs": 2555, "temp_data": 90}
DEFAULT_RETENTION_DAYS = 365
LAWFUL_PURPOSES = ("contract_fulfillment", "legal_obligation", "legitimate_interest", "consent")


def extra_fields(requested: Column, required: Column) -> Column:
    return F.array_except(requested, required)


def minimise(df: DataFrame, required: list[str]) -> DataFrame:
    return df.select(*[c for c in df.columns if c in required])


def retention_ok(data_type: Column, days: Column) -> Column:
    return days <= lookup(data_type, MAX_RETENTION_DAYS, DEFAULT_RETENTION_DAYS)


def expired(date: Column, as_of: str, days: int) -> Column:
    return F.datediff(F.lit(as_of).cast("date"), date) > days


def lawful(purpose: Column, consent: Column) -> Column:
    return purpose.isin(*LAWFUL_PURPOSES) | F.coalesce(consent, F.lit(False))


def erase(df: DataFrame, subjects: DataFrame, key: str, subject_key: str) -> DataFrame:
    return df.join(subjects, df[key] == subjects[subject_key], "left_anti")


def path_safe(path: Column) -> Column:
    return ~(path.contains("..") | path.startswith("/"))


def over_size(df: DataFrame, dataset: str, size: str, max_mb: float = 100.0) -> DataFrame:
    """Total size per dataset and whether it is above the limit."""
    mb = F.sum(size) / F.lit(1024.0 * 1024.0)
    return df.groupBy(dataset).agg(F.sum(size).alias("size_bytes"), (mb > F.lit(max_mb)).alias("over_limit"))


def k_anonymity(df: DataFrame, quasi: list[str], k: int) -> DataFrame:
    """Smallest group over the quasi-identifiers, groups below k and rows in them."""
    groups = df.groupBy(*quasi).agg(F.count("*").alias("n"))
    small = F.col("n") < k
    return groups.agg(
        F.min("n").alias("k_min"), F.count("*").alias("n_groups"),
        F.count_if(small).alias("groups_below_k"), F.coalesce(F.sum(F.when(small, F.col("n"))), F.lit(0)).alias("rows_below_k"))


def coverage(expected: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Expected keys, present keys and their ratio."""
    hit = expected.select(key).distinct().join(present.select(key).distinct().withColumn("_hit", F.lit(1)), key, "left")
    return hit.agg(
        F.count("*").alias("expected"), F.count("_hit").alias("present"), F.round(share(F.col("_hit").isNotNull()), 6).alias("coverage"))


def latest_state(log: DataFrame, key: str, at: list[str]) -> DataFrame:
    """Current row of each run of an append-only audit log."""
    rest = [c for c in log.columns if c != key and c not in at]
    return log.groupBy(key).agg(F.max(F.struct(*at, *rest)).alias("s")).select(key, "s.*")
