"""Ordered helpers against brute force, with one key holding a third of all rows."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voltlake.functions import ordered as O
from voltlake.functions.quantiles import percentiles, robust_z

HOUR = 3_600_000_000


def rows(seed=1, n=300):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = None if i % 3 == 0 else rng.randrange(1, 12)  # the null key is the hot one
        out.append((i, key, rng.randrange(0, 20 * 24) * HOUR // 2, rng.choice([None, 1, 2, 3, 5])))
    return out


@pytest.fixture
def df(spark):
    return spark.createDataFrame(rows(), "id long, k int, at long, v int")


def test_running_total(df):
    got = {r["id"]: (r["s"], r["s_all"]) for r in O.running_total(df, ["k"], O.time_slot(F.col("at"), 3600 * 12), ["at", "id"], {"s": F.lit(1)}, whole=True).collect()}
    data = rows()
    for i, k, at, _ in data:
        assert got[i] == (sum(1 for j, q, b, _ in data if q == k and (b, j) <= (at, i)), sum(1 for _, q, _, _ in data if q == k))


def test_carry_last(df):
    got = {r["id"]: r["v"] for r in O.carry_last(df, ["k"], O.time_slot(F.col("at"), 3600 * 12), ["at", "id"], ["v"]).collect()}
    data = rows()
    for i, k, at, _ in data:
        past = [(b, j, v) for j, q, b, v in data if q == k and (b, j) <= (at, i) and v is not None]
        assert got[i] == (max(past)[2] if past else None)


@pytest.mark.parametrize("following", [False, True])
def test_neighbour(df, following):
    got = {r["id"]: r["n"] for r in O.neighbour(df, ["k"], O.time_slot(F.col("at"), 3600 * 12), ["at", "id"], {"n": "id"}, following).collect()}
    data = rows()
    for i, k, at, _ in data:
        near = [(b, j) for j, q, b, _ in data if q == k and ((b, j) > (at, i) if following else (b, j) < (at, i))]
        assert got[i] == ((min(near) if following else max(near))[1] if near else None)


@pytest.mark.parametrize("inclusive", [False, True])
def test_trailing_total(df, inclusive):
    got = {(r["k"], r["at"]): r["n"] for r in O.trailing_total(df, ["k"], "at", {"n": F.lit(1)}, 6 * 3600, inclusive).collect()}
    data = rows()
    span = 6 * HOUR
    for _, k, at, _ in data:
        assert got[(k, at)] == sum(1 for _, q, b, _ in data if q == k and b <= at and (b >= at - span if inclusive else b > at - span))


def test_ranked_and_tile(spark):
    data = [(i, float(i % 3)) for i in range(47)]
    r = O.ranked(spark.createDataFrame(data, "id long, s double"), "s", "id")
    got = {x["id"]: (x["rank_no"], x["t"]) for x in r.withColumn("t", O.tile(F.col("rank_no"), F.col("rows_all"), 5)).collect()}
    order = [i for i, _ in sorted(data, key=lambda p: (p[1], p[0]))]
    sizes = [10, 10, 9, 9, 9]
    tiles = [t + 1 for t, n in enumerate(sizes) for _ in range(n)]
    for pos, i in enumerate(order):
        assert got[i] == (pos + 1, tiles[pos])


def test_asof_ties_take_the_row_at_the_same_time(spark):
    left = spark.createDataFrame([(1, 1, 10), (2, 1, 4), (3, 2, 10)], "id int, k int, t long")
    right = spark.createDataFrame([(1, 10, "a"), (1, 5, "b"), (1, 11, "c")], "k int, u long, v string")
    got = {r["id"]: r["v"] for r in O.asof(left, right, ["k"], "t", "u", ["v"]).collect()}
    assert got == {1: "a", 2: None, 3: None}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.floats(-100, 100, allow_nan=False)), min_size=1, max_size=60))
def test_percentiles(spark, data):
    import numpy as np

    df = spark.createDataFrame(data, "k int, x double")
    for r in percentiles(df, ["k"], "x", {"a": 0.05, "b": 0.5, "c": 1.0}).collect():
        xs = [x for k, x in data if k == r["k"]]
        assert [r["a"], r["b"], r["c"]] == pytest.approx([np.quantile(xs, q) for q in (0.05, 0.5, 1.0)], abs=1e-9)


def test_zero_mad_gives_no_score(spark):
    z = robust_z(spark.createDataFrame([(1, 5.0), (1, 5.0), (1, 9.0)], "k int, x double"), ["k"], "x")
    assert all(r["z"] is None for r in z.collect())


def test_bands(spark):
    from voltlake.operators.joins import band

    bands = spark.createDataFrame([(f"b{i}", float(i), i + 0.5) for i in range(150)], "band string, lo double, hi double")
    df = spark.createDataFrame([(i, None if i % 50 == 49 else i * 0.25 - 1) for i in range(700)], "id int, x double")
    got = {r["id"]: r["band"] for r in band(df, "x", bands, "lo", "hi", "band").collect()}
    for i in range(700):
        x = i * 0.25 - 1
        assert got[i] == (f"b{int(x)}" if i % 50 != 49 and 0 <= x < 150 and x % 1 < 0.5 else None)


def test_null_scores_rank_first_and_stay(spark):
    data = [(i, None if i % 10 == 0 else float("nan") if i % 10 == 1 else float(i % 7)) for i in range(200)]
    got = {r["id"]: (r["rank_no"], r["rows_all"]) for r in O.ranked(spark.createDataFrame(data, "id long, s double"), "s", "id").collect()}
    order = sorted(data, key=lambda p: (p[1] is not None, p[1] != p[1], p[1] if p[1] is not None and p[1] == p[1] else 0, p[0]))
    assert got == {i: (k + 1, 200) for k, (i, _) in enumerate(order)}


def test_auc_with_null_scores(spark):
    from voltlake.operators.metrics import auc

    data = [(None if i % 5 == 0 else (i * 37 % 11) / 10, int(i % 3 == 0)) for i in range(90)]
    at = lambda s: -1.0 if s is None else s
    pos, neg = [at(s) for s, y in data if y], [at(s) for s, y in data if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert auc(spark.createDataFrame(data, "s double, y int"), "s", "y").first()["auc"] == pytest.approx(want, abs=1e-6)


def test_rows_of_a_null_key_keep_their_score(spark):
    z = robust_z(spark.createDataFrame([(None if i % 2 else i % 3, float(i * i)) for i in range(40)], "k int, x double"), ["k"], "x")
    assert z.count() == 40 and z.where("k is null and median is null").isEmpty()


def test_burst_at_one_instant(spark):
    data = [(i, 1, 0 if i % 10 else i * HOUR) for i in range(400)]
    got = {r["id"]: r["s"] for r in O.running_total(spark.createDataFrame(data, "id long, k int, at long"), ["k"], O.time_slot(F.col("at"), 3600), ["at", "id"], {"s": F.lit(1)}).collect()}
    assert got == {i: k + 1 for k, (i, _, _) in enumerate(sorted(data, key=lambda x: (x[2], x[0])))}
