"""One bound over all segments against exhaustive search."""

import itertools

import pytest

from voltlake.operators import pricing

SEGMENTS = [("a", 10.0, 100.0), ("b", 25.0, 40.0), ("c", 3.0, 900.0), ("d", 8.0, 0.0)]


@pytest.mark.parametrize("max_loss,elasticity", [(0.05, -1.5), (0.0, -1.5), (0.2, -1.2), (5.0, -1.5), (-0.1, -1.5), (-9.0, -1.5)])
def test_bounded_prices(spark, max_loss, elasticity):
    cands = pricing.candidates(spark.createDataFrame([*SEGMENTS, ("e", None, None)], "segment string, p0 double, q0 double"), elasticity=elasticity)
    chosen, report = pricing.best_within(cands, max_loss)
    rows = {}
    for r in cands.where("margin is not null").collect():
        rows.setdefault(r.segment, []).append((r.margin, r.q0 - r.demand, r.factor))
    budget = max_loss * sum(q for _, _, q in SEGMENTS)
    fits = [x for x in itertools.product(*rows.values()) if sum(c[1] for c in x) <= budget + 1e-6]
    picked = chosen.collect()
    assert {r.segment for r in picked} == set("abcd") and report["feasible"] == bool(fits)
    assert sum(r.margin for r in picked) == pytest.approx(report["margin"]) and sum(r.lost for r in picked) == pytest.approx(report["lost"])
    if fits:
        best = max(sum(c[0] for c in x) for x in fits)
        assert report["lost"] <= budget + 1e-6
        assert report["margin"] - 1e-6 <= best <= report["margin"] + report["gap"] + 1e-6
        # what the price gives is the best choice of all that lose no more
        assert report["margin"] == pytest.approx(max(sum(c[0] for c in x) for x in fits if sum(c[1] for c in x) <= report["lost"] + 1e-6))
    else:
        assert report["lost"] == pytest.approx(sum(min(c[1] for c in own) for own in rows.values()))


def test_no_segments(spark):
    cands = pricing.candidates(spark.createDataFrame([], "segment string, p0 double, q0 double"))
    chosen, report = pricing.best_within(cands, 0.1)
    assert chosen.count() == 0 and report["margin"] == 0.0
