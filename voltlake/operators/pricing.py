"""Tariff search on a grid of candidate rates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voltlake.functions.scalars import r6, ratio
from voltlake.session import stored

GRID = tuple(round(0.80 + 0.05 * i, 2) for i in range(9))
COST_SHARE, ELASTICITY, STANDING_SHARE = 0.7, -1.5, 0.05


def candidates(segments: DataFrame, grid=GRID, cost_share: float = COST_SHARE, elasticity: float = ELASTICITY) -> DataFrame:
    """Every segment under every candidate factor. The grid is fixed, so each row is expanded in place."""
    f = F.col("factor")
    c = segments.select("segment", "p0", "q0", F.explode(F.array(*[F.lit(float(g)) for g in grid])).alias("factor"))
    return c.select(
        "segment", "p0", "q0", "factor", (F.col("p0") * f).alias("price"), (F.col("q0") * F.pow(f, F.lit(elasticity))).alias("demand")).select(
        "*", ((F.col("price") - F.col("p0") * cost_share) * F.col("demand")).alias("margin"), (F.col("price") * F.col("demand")).alias("revenue"),
        (F.col("p0") * (1 - cost_share) * F.col("q0")).alias("margin0"))


def best(cands: DataFrame, strategy: str) -> DataFrame:
    """Best candidate per segment; among equals the one nearest the lowest factor."""
    if strategy == "maximize_margin":
        goal, allowed = F.col("margin"), F.lit(True)
    else:
        goal, allowed = F.col("demand"), F.col("margin") >= F.col("margin0") * F.lit(1 - 1e-12)
    row = F.struct(goal.alias("goal"), (-F.col("factor")).alias("nf"), "price", "p0", "q0", "demand", "margin", "margin0", "revenue")
    g = cands.where(allowed).groupBy("segment").agg(F.max(row).alias("b"))
    return g.select(
        "segment", F.lit(strategy).alias("strategy"), F.round(F.col("b.price"), 4).alias("unit_rate"), F.round(F.col("b.p0") * STANDING_SHARE, 4).alias("standing_charge"),
        r6(ratio("b.margin", "b.margin0") - 1).alias("margin_impact"), r6(ratio("b.demand", "b.q0") - 1).alias("demand_impact"),
        (-F.col("b.nf")).alias("factor"))


def best_within(cands: DataFrame, max_loss: float, width: int = 32, rounds: int = 5) -> tuple[DataFrame, dict]:
    """Candidates of largest total margin while all segments together lose at most ``max_loss`` of today's demand, and a report.

    The bound is one price on lost demand (a Lagrange multiplier): each segment takes the candidate of best margin less price x loss, and the smallest price that
    keeps the bound is narrowed down ``width`` values a pass over the segments; only totals reach the driver. The best margin of all choices lies between ``margin`` and
    ``margin`` + ``gap`` of the report. A bound that no choice keeps gives the choice of least loss, ``feasible`` false.
    """
    lost = F.col("q0") - F.col("demand")
    packed = stored(cands.where(lost.isNotNull() & F.col("margin").isNotNull()).groupBy("segment").agg(
        F.collect_list(F.struct("factor", "margin", lost.alias("lost"))).alias("c"), F.max("q0").alias("q0")), "candidates")  # one row a segment

    def pick(price: float):
        least = math.isinf(price)
        value = lambda x: -x["lost"] if least else x["margin"] - F.lit(float(price)) * x["lost"]
        return F.array_max(F.transform("c", lambda x: F.struct(value(x).alias("v"), (-x["lost"]).alias("kept"), x["margin"].alias("margin"), (-x["factor"]).alias("nf"))))

    def totals(prices: list[float]) -> list[tuple[float, float, float]]:
        row = packed.select("q0", *[pick(p).alias(f"b{i}") for i, p in enumerate(prices)]).agg(
            F.sum("q0").alias("q"), *[f(F.sum(f"b{i}.{n}")).alias(f"{n}{i}") for i in range(len(prices)) for n, f in (("margin", lambda c: c), ("kept", lambda c: -c))]).first()
        nonlocal budget
        budget = max_loss * (row["q"] or 0.0)
        return [(p, row[f"margin{i}"] or 0.0, row[f"kept{i}"] or 0.0) for i, p in enumerate(prices)]

    budget = 0.0
    seen = totals([0.0, math.inf])
    ok = lambda t: t[2] <= budget + 1e-9 * max(1.0, abs(budget))
    low, high = 0.0, math.inf
    if ok(seen[0]):
        high = 0.0
    elif ok(seen[1]):
        scale = totals([2.0 ** k for k in range(-width // 2, width // 2 + 1)])
        seen += scale
        high = min((t[0] for t in scale if ok(t)), default=math.inf)
        low = max((t[0] for t in scale if not ok(t) and t[0] < high), default=0.0)
        for _ in range(rounds if math.isfinite(high) else 0):
            grid = totals([low + (high - low) * i / (width + 1) for i in range(1, width + 1)])
            seen += grid
            high = min([high, *(t[0] for t in grid if ok(t))])
            low = max([low, *(t[0] for t in grid if not ok(t) and t[0] < high)])
    chosen = next(t for t in seen if t[0] == high)
    dual = min((m + p * (budget - l) for p, m, l in seen if math.isfinite(p)))
    report = {"price": high, "margin": chosen[1], "lost": chosen[2], "budget": budget, "gap": max(0.0, dual - chosen[1]), "feasible": ok(chosen)}
    b = packed.select("segment", "q0", pick(high).alias("b"))
    return b.select("segment", (-F.col("b.nf")).alias("factor"), F.col("b.margin").alias("margin"), (-F.col("b.kept")).alias("lost")), report


def sensitivity(cands: DataFrame) -> DataFrame:
    """Objective per scenario and its slope between neighbouring factors; nine rows per segment."""
    w = W.partitionBy("segment").orderBy("factor")
    slope = (F.col("margin") - F.lag("margin").over(w)) / (F.col("factor") - F.lag("factor").over(w))
    return cands.select("segment", "factor", F.round("margin", 2).alias("margin"), F.round(slope, 2).alias("slope"))


def relaxed(cands: DataFrame, min_margin_gain: float, min_demand_share: float) -> DataFrame:
    """Candidate that meets the constraints, else the one that violates them least."""
    violation = F.greatest(F.lit(0.0), F.lit(1 + min_margin_gain) - F.col("margin") / F.col("margin0")) + F.greatest(F.lit(0.0), F.lit(min_demand_share) - F.col("demand") / F.col("q0"))
    row = F.struct((violation <= 1e-9).alias("feasible"), (-F.round(violation, 9)).alias("nv"), F.col("margin").alias("m"), (-F.col("factor")).alias("nf"))
    return cands.groupBy("segment").agg(F.max(row).alias("b")).select("segment", F.col("b.feasible").alias("feasible"), r6(-F.col("b.nv")).alias("violation"), (-F.col("b.nf")).alias("factor"))


def kpis(cands: DataFrame, chosen: DataFrame) -> DataFrame:
    """Revenue of the chosen rates against today's, and mean over spread of the scenario margins."""
    new = cands.join(chosen.select("segment", F.col("factor").alias("pick")), "segment")
    g = new.groupBy("segment").agg(
        F.max(F.when(F.col("factor") == F.col("pick"), F.col("revenue"))).alias("new"), F.max(F.col("p0") * F.col("q0")).alias("now"),
        F.avg("margin").alias("m"), F.stddev_samp("margin").alias("sd"))
    up, rar = ratio(F.sum("new"), F.sum("now")) - 1, ratio(F.sum("m"), F.sum("sd"))
    return g.agg(r6(up).alias("revenue_improvement"), r6(rar).alias("risk_adjusted_return"), (up >= 0.02).alias("revenue_ok"), (rar >= 1.5).alias("return_ok"))
