"""Personal data: schema flags, value scans, row guard, masking and access audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltlake.functions.quantiles import robust_z
from voltlake.functions.scalars import day_text, lookup

# Words that mark a column name, the three pattern sets and the severities.
PII_WORDS = (
    "email", "phone", "mobile", "address", "postcode", "postal_code", "zip_code", "national_insurance", "ni_number", "ssn",
    "credit_card", "bank_account", "iban", "sort_code",
)
AUDIT_PATTERNS = {
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "phone": r"(\+44|0)\d{10,11}",
    "postcode": r"[A-Z]{1,2}\d{1,2}[A-Z]?\s?\d[A-Z]{2}",
    "ni_number": r"[A-Z]{2}\d{6}[A-Z]",
}
CATALOG_PATTERNS = {
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "phone": r"\+?[\d\s\-\(\)]{10,}",
    "postcode": r"[A-Z]{1,2}\d{1,2}[A-Z]?\s?\d[A-Z]{2}",
    "account_number": r"ACC\d{8,12}",
    "mpan": r"\d{13}",
}
GUARD_PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
}
SEVERITY = {"postcode": "medium"}
HASHED_FIELDS = ("customer_email_hash", "phone_hash")


def name_is_pii(name: Column) -> Column:
    low = F.lower(name)
    return reduce(lambda a, b: a | b, [low.contains(w) for w in PII_WORDS])


def scan_values(df: DataFrame, fields: list[str], patterns: dict[str, str]) -> DataFrame:
    """Matches per field and type. Counts are summed on the map side in one pass over the text; no text is shuffled."""
    sums = df.select(*fields).agg(*[
        F.coalesce(F.sum(F.regexp_count(F.col(f), F.lit(p))), F.lit(0)).alias(f"{f}|{k}") for f in fields for k, p in patterns.items()])
    cells = F.array(*[
        F.struct(F.lit(f).alias("field"), F.lit(k).alias("type"), F.col(f"`{f}|{k}`").alias("count")) for f in fields for k in patterns])
    return sums.select(F.inline(cells)).withColumn("severity", lookup(F.col("type"), SEVERITY, "high"))


def violations(findings: DataFrame) -> DataFrame:
    """Findings in fields that are not on the hashed list."""
    return findings.where((F.col("count") > 0) & ~F.col("field").isin(*HASHED_FIELDS)).select(
        "field", "type", F.lit("Unmasked PII in data layer").alias("violation"), F.lit("Apply hashing or tokenization").alias("recommendation"))


def has_pii(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in GUARD_PATTERNS.values()])


def mask(text: Column, patterns: dict[str, str] | None = None) -> Column:
    """Replace matches by ``[TYPE]``, pattern after pattern in the given order."""
    return reduce(lambda c, kv: F.regexp_replace(c, F.lit(kv[1]), F.lit(f"[{kv[0].upper()}]")), (patterns or AUDIT_PATTERNS).items(), text)


def detector_scores(df: DataFrame, hit: Column, truth: Column) -> DataFrame:
    """Recall and false-positive rate of a detector against labelled rows."""
    c = df.agg(F.count_if(hit & truth).alias("tp"), F.count_if(hit & ~truth).alias("fp"),
               F.count_if(~hit & truth).alias("fn"), F.count_if(~hit & ~truth).alias("tn"))
    return c.select("*", F.round(F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0)), 6).alias("recall"),
                    F.round(F.col("fp") / F.nullif(F.col("fp") + F.col("tn"), F.lit(0)), 6).alias("false_positive_rate"))


def suspicious_access(log: DataFrame, granted: DataFrame, limit: float) -> DataFrame:
    """User-days with an outlying number of accesses, and accesses to resources the user holds no grant for."""
    daily = log.groupBy("user_id", F.col("ts").cast("date").alias("ds")).agg(F.count("*").alias("n"))
    volume = robust_z(daily, ["user_id"], "n").where(F.col("z") > limit).select(
        "user_id", day_text("ds").alias("ds"), F.lit(None).cast("string").alias("resource"), "n", F.lit("volume").alias("reason"))
    used = log.groupBy("user_id", "resource").agg(F.count("*").alias("n"))
    grants = granted.select("user_id", "resource").distinct()
    foreign = used.join(grants, ["user_id", "resource"], "left_anti").select(
        "user_id", F.lit(None).cast("string").alias("ds"), "resource", "n", F.lit("no_grant").alias("reason"))
    return volume.unionByName(foreign)
