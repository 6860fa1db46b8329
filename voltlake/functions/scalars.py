"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ts_text(c) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def day_text(c) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd")


def ds_text(c) -> Column:
    """Partition value of a date, ``yyyyMMdd``."""
    return F.date_format(col(c), "yyyyMMdd")


def money(c, scale: int = 2) -> Column:
    """Exact decimal, so that sums do not depend on the order of the rows."""
    return col(c).cast(f"decimal(18,{scale})")


def minor(c, scale: int = 2) -> Column:
    """Whole minor units of an amount with ``scale`` decimals; adding them is exact and fast, and overflow raises."""
    return F.rint(col(c) * float(10 ** scale)).cast("long")


def money_sum(c, scale: int = 2) -> Column:
    return F.sum(minor(c, scale)).cast("double") / float(10 ** scale)


def ratio(a, b) -> Column:
    """Quotient as a double; null where the divisor is 0 or null."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def r6(c) -> Column:
    return F.round(col(c).cast("double"), 6)


def r4(c) -> Column:
    return F.round(col(c).cast("double"), 4)


def share(cond: Column) -> Column:
    """Share of rows for which the condition holds; null and false both count as not."""
    return F.avg(F.when(cond, 1.0).otherwise(0.0))


def first_reason(rules: list[tuple[Column, Column | str]], otherwise: str) -> Column:
    """The reason of the first rule whose condition holds."""
    out = None
    for cond, reason in rules:
        r = F.lit(reason) if isinstance(reason, str) else reason
        out = F.when(cond, r) if out is None else out.when(cond, r)
    return out.otherwise(F.lit(otherwise))


def lookup(key: Column, table: dict, default=None) -> Column:
    """Value of a fixed table; the table becomes part of the expression, so nothing is joined."""
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution, from the rational approximation 7.1.26 of Abramowitz and Stegun."""
    x = F.abs(z) / F.lit(2.0 ** 0.5)
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    erf = 1.0 - poly * F.exp(-x * x)
    return 0.5 * (1.0 + F.when(z < 0, -erf).otherwise(erf))


def normal_cdf_sql(z: str) -> str:
    """The same distribution as SQL text for the oracle."""
    x = f"(abs({z}) / sqrt(2e0))"
    t = f"(1e0 / (1e0 + 0.3275911e0 * {x}))"
    erf = (f"(1e0 - (((((1.061405429e0 * {t} - 1.453152027e0) * {t} + 1.421413741e0) * {t} - 0.284496736e0) * {t}"
           f" + 0.254829592e0) * {t}) * exp(-{x} * {x}))")
    return f"(0.5e0 * (1e0 + case when {z} < 0 then -{erf} else {erf} end))"
