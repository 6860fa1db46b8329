"""Cleansing steps of the bronze to silver job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the e-mail pattern of the customer contract.
EMAIL_PATTERN = r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$"
DATE_FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "yyyyMMdd")


def dedup_latest(df: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """One row per key: the one with the highest version, given as columns that together order all rows.

    An aggregate instead of a window: copies of a hot key are reduced before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys and c not in version]
    best = df.groupBy(*keys).agg(F.max(F.struct(*version, *rest)).alias("_r"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_r.{c}") for c in df.columns])


def hash_pii(df: DataFrame, columns: list[str], salt: str) -> DataFrame:
    """Replace each column by ``<name>_hash``, a salted SHA-256 of its trimmed lower-case text."""
    return reduce(
        lambda d, c: d.withColumn(f"{c}_hash", F.sha2(F.concat(F.lit(salt), F.lower(F.trim(c))), 256)).drop(c), columns, df)


def email_valid(c: str) -> Column:
    return F.col(c).rlike(EMAIL_PATTERN)


def standard_date(c: str, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """Date of a text in the first format that fits, else null."""
    return F.coalesce(*[F.try_to_timestamp(F.col(c), F.lit(f)).cast("date") for f in formats])


def drop_test_accounts(df: DataFrame, rule: Column) -> DataFrame:
    return df.filter(~F.coalesce(rule, F.lit(False)))


def blank_to_null(c: str) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def bronze_to_silver(bronze: DataFrame, key: str, version: list[str], email: str, date: str, test_rule: Column,
                     salt: str) -> DataFrame:
    """Deduplicate, check and hash the e-mail, standardise the date and drop test accounts, in one job."""
    return (
        bronze.transform(dedup_latest, [key], version)
        .filter(email_valid(email))
        .transform(hash_pii, [email], salt)
        .withColumn(date, standard_date(date))
        .transform(drop_test_accounts, test_rule)
    )


STEPS = ("deduplicate", "validate_email", "hash_pii", "standardize_dates", "drop_test_accounts")


def cleansing_report(bronze: DataFrame, silver: DataFrame) -> DataFrame:
    """Rows in, rows out and the steps applied."""
    both = bronze.select(F.lit(1).alias("i"), F.lit(0).alias("o")).unionAll(silver.select(F.lit(0), F.lit(1)))
    return both.agg(F.sum("i").alias("records_in"), F.sum("o").alias("records_out")).withColumn(
        "transformations", F.lit(",".join(STEPS)))
