"""Attributions of tree ensembles against the definition over all subsets of features."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltlake.operators import explain, models


def expectation(by, tree, x, known, at=0):
    """Value of a tree when only the ``known`` features are: other splits are averaged by their training rows."""
    r = by[tree, at]
    if r["left"] < 0:
        return r["value"]
    if r["feature"] in known:
        return expectation(by, tree, x, known, r["left"] if x[r["feature"]] <= r["threshold"] else r["right"])
    return sum(by[tree, c]["rows"] / r["rows"] * expectation(by, tree, x, known, c) for c in (r["left"], r["right"]))


def by_subsets(nodes, x, m):
    by = {(r["tree"], r["id"]): r for r in nodes}
    weight = {r["tree"]: r["weight"] for r in nodes}
    value = lambda known: sum(w * expectation(by, t, x, known) for t, w in weight.items())
    out = []
    for i in range(m):
        rest = [j for j in range(m) if j != i]
        out.append(sum(math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) * (value({*s, i}) - value(set(s))) for k in range(m) for s in itertools.combinations(rest, k)))
    return out, value(set())


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] * x[:, 2] > 0.2)).astype(int)
    df = spark.createDataFrame([(i, *map(float, r), int(v)) for i, (r, v) in enumerate(zip(x, y))], "k long, a double, b double, c double, label int")
    return models.pipeline(["a", "b", "c"], kind="gbt", max_iter=4).fit(df), df


def test_tree_attributions(spark, fitted):
    model, df = fitted
    got = {r.k: r for r in explain.explain_trees(model, df, "k", ["a", "b", "c"]).collect()}
    nodes = explain.node_table(model.stages[-1], spark).collect()
    scored = model.transform(df).collect()
    assert len(got) == len(scored) == 400
    for r in scored:
        own = got[r.k]
        assert own.raw == pytest.approx(r.rawPrediction[1], abs=1e-9) and own.a + own.b + own.c == pytest.approx(own.raw - own.base, abs=1e-9)
    for r in scored[:25]:
        want, base = by_subsets(nodes, list(r.features), 3)
        assert [got[r.k].a, got[r.k].b, got[r.k].c] == pytest.approx(want, abs=1e-9) and got[r.k].base == pytest.approx(base)
        assert got[r.k].top_driver == "abc"[int(np.abs(want).argmax())]
    assert explain.explain_trees(model, df.where("k < 0"), "k", ["a", "b", "c"]).count() == 0


def test_attributions_of_the_churn_model(spark):
    import __spark_entry__ as entry

    out = entry.queries()["ml_explain_trees"](spark, "/root/testdata/sf0.001")
    bad = out.where(F.abs(F.col("n") + F.col("spend") + F.col("recency") + F.col("base") - F.col("raw")) > 1e-9)
    assert out.count() > 50 and bad.isEmpty()
