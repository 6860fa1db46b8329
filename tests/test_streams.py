"""Streams in several batches: bounded state, late rows, replayed batches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from voltlake.streaming import jobs

AT = dt.datetime(2024, 3, 1, 12)


def write(spark, path, rows):
    """A file of (key, hours after AT)."""
    frame = spark.createDataFrame([(k, AT + dt.timedelta(hours=h)) for k, h in rows], "k long, ts timestamp")
    frame.coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return jobs.source(spark, path, "k long, ts timestamp", max_files=1)


def rows_in_state(query):
    return query.recentProgress[-1].stateOperators[0].numRowsTotal


def trailing(rows, least=3, hours=24):
    out = {}
    for k, h in rows:
        n = sum(a == k and h - hours < b <= h for a, b in rows)
        if n >= least:
            out[k, h] = n
    return out


def read(spark, path):
    got = jobs.merged(spark, path, "k long, at long, n long", ["k", "at"]).collect()
    return {(r.k, (r["at"] - int(AT.replace(tzinfo=dt.timezone.utc).timestamp() * 1e6)) / 3.6e9): r.n for r in got}


def test_recurring_errors_keep_a_span_of_state(spark, tmp_path):
    batches = [
        [(1, 0), (1, 1), (2, 0), (None, 0), (None, 0), (None, 2)],
        [(1, 2), (1, 1.5), (1, 2), (2, 23.9), (2, 24)],  # repeated times, one that comes late, the oldest instant
        [(1, 25), (2, 24.5), (3, 25)],
        [(3, 200)],  # all others are quiet for more than a day
    ]
    path, out, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    done, states = [], []
    for batch in batches:
        write(spark, path, batch)
        done += batch
        q = jobs.recurring_errors(stream(spark, path), ["k"], out, cp, lateness="2 hours")
        states.append(rows_in_state(q))
        assert read(spark, out) == trailing(done)
    assert states[-1] < states[-2]
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "out").glob("batch=*"))
    layer = spark.read.parquet(f"{out}/batch={last}")
    jobs._layer(out)(spark.createDataFrame(layer.collect(), layer.schema), last)  # the batch is run again
    assert read(spark, out) == trailing(done)


def test_panes_and_sliding_windows(spark, tmp_path):
    rows = [(1, 0.1), (1, 0.2), (1, 5), (2, 3.5), (1, 30), (None, 7), (1, 23.99), (2, 27.5), (2, 51.9)]
    path, out, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    for k in range(0, len(rows), 3):
        write(spark, path, rows[k: k + 3])
        jobs.panes(stream(spark, path), "1 hour", ["k"], out, cp, lateness="60 hours")
    counts = jobs.merged(spark, out, "start timestamp, k long, n long", ["start", "k"])
    for length, least in ((24, 1), (24, 2), (1, 1), (6, 2)):
        got = {(r.k, (r.start - AT).total_seconds() / 3600): r.n for r in jobs.sliding(counts, length * 3600, 3600, ["k"], least).collect()}
        want = {}
        for k in {k for k, _ in rows}:
            for s in range(-30, 60):
                n = sum(a == k and s <= h < s + length for a, h in rows)
                if n >= least:
                    want[k, s] = n
        assert got == want
    with pytest.raises(ValueError):
        jobs.sliding(counts, 5000, 3600, ["k"])


def test_rows_shuffled_for_sliding_windows(spark, tmp_path):
    """Two rows a pane, however long the windows are."""
    counts = spark.range(500).select(F.timestamp_seconds(F.col("id") * 3600).alias("start"), (F.col("id") % 3).alias("k"), F.lit(2).cast("long").alias("n"))
    for length in (24, 240):
        plan = jobs.sliding(counts, length * 3600, 3600, ["k"])._jdf.queryExecution().executedPlan().toString()
        assert plan.index("Generate explode") < plan.index("Exchange")  # windows are filled in above all shuffles


def test_tumbling_state_is_bounded(spark, tmp_path):
    path, out, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    sizes = []
    for day in range(6):
        write(spark, path, [(k, 24 * day + k) for k in range(20)])
        sizes.append(rows_in_state(jobs.tumbling(stream(spark, path), "1 hour", [], {"n": F.count("*")}, out, cp, lateness="1 hour")))
    assert max(sizes) <= 25
    got = jobs.merged(spark, out, "start timestamp, n long", ["start"])
    assert got.count() == 120 and got.agg(F.sum("n")).first()[0] == 120
