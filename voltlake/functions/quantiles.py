"""Exact percentiles by counting: no task ever holds all values of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlake.functions.ordered import join_back, running_total, value_slot
from voltlake.session import stored


def percentiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linearly interpolated percentiles per key; one row per key with ``probs``' names as columns."""
    present = df.where(F.col(value).isNotNull())
    counts = present.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    run = running_total(counts, keys, lambda: value_slot(present, value), [value], {"_upto": F.col("_n")}, whole=True)
    x, last, first = F.col(value).cast("double"), F.col("_upto"), F.col("_upto") - F.col("_n")
    parts, out = [], []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("_upto_all") - 1)
        for tag, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            parts.append(F.max(F.when((first <= at) & (at < last), x)).alias(f"_{tag}_{name}"))
        frac = F.lit(float(p)) * (F.col("_all") - 1)
        frac = frac - F.floor(frac)
        out.append((F.col(f"_lo_{name}") + frac * (F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))).alias(name))
    return run.groupBy(*keys).agg(F.max("_upto_all").alias("_all"), *parts).select(*keys, *out)


def robust_z(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Add ``median``, ``mad`` and ``z`` = 0.6745 (x - median) / MAD per key; ``z`` is null where MAD is 0.

    The statistics, one row a key, are stored: an aggregate below the joins would keep a hot key's rows in one task.
    """
    med = stored(percentiles(df, keys, value, {"median": 0.5}), "medians")
    dev = join_back(df, med, keys).withColumn("_dev", F.abs(F.col(value) - F.col("median")))
    both = stored(join_back(percentiles(dev, keys, "_dev", {"mad": 0.5}), med, keys), "deviations")
    z = F.when(F.col("mad") > 0, F.lit(0.6745) * (F.col(value) - F.col("median")) / F.col("mad"))
    return join_back(df, both, keys).withColumn("z", z)
