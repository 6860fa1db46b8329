"""Streaming jobs, each run to its end and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltlake.functions.scalars import ts_text
from voltlake.operators import quality as Q
from voltlake.plans.registry import query
from voltlake.session import scratch
from voltlake.streaming import jobs as J
from voltlake.tables import SCHEMAS

BUDGET = 14_000.0


def events_stream(t, **kw):
    # a pattern is used because the table may be one file or a folder of files
    return J.source(t.spark, f"{t.path}/events.[p]arquet", SCHEMAS["events"], **kw)


def arrivals(t, out):
    """Events as several files in event order, so that a stream sees several micro-batches."""
    t.events.repartitionByRange(4, "ts").write.parquet(f"{out}/in")
    return J.source(t.spark, f"{out}/in", SCHEMAS["events"], max_files=1)


def arrivals_in_order(t, out, where="true", parts=4):
    """Events as files in event order, written one after the other, so that a watermark finds them in time. The cuts are few numbers."""
    rows = t.events.where(where)
    at = rows.select(F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("x"))
    cuts = at.approxQuantile("x", [i / parts for i in range(1, parts)], 0.01)
    for lo, hi in zip([float("-inf"), *cuts], [*cuts, float("inf")]):
        x = F.unix_micros(F.col("ts").cast("timestamp")).cast("double")
        rows.where((x >= lo) & (x < hi)).coalesce(1).write.mode("append").parquet(f"{out}/in")
    return J.source(t.spark, f"{out}/in", SCHEMAS["events"], max_files=1)


@query("src_stream_bronze", "select count(*) as records_processed, 0 as last_batch, count(*) as rows_landed from events")
def src_stream_bronze(t):
    out = scratch(t.spark, "stream-bronze")
    q = J.ingest(events_stream(t), f"{out}/bronze", f"{out}/cp")
    n, batch = J.processed(q)
    landed = t.spark.read.parquet(f"{out}/bronze").agg(F.count("*").alias("rows_landed"))
    return landed.select(F.lit(n).cast("long").alias("records_processed"), F.lit(batch).alias("last_batch"), "rows_landed")


@query("st_ingest", "select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as ts, user_id, event_type, value, strftime(ts, '%Y%m%d') as ds from events")
def st_ingest(t):
    out = scratch(t.spark, "ingest")
    J.ingest(arrivals(t, out), f"{out}/bronze", f"{out}/cp")
    r = t.spark.read.parquet(f"{out}/bronze")
    return r.select("event_id", ts_text("ts").alias("ts"), "user_id", "event_type", "value", F.col("ds").cast("string").alias("ds"))


@query("st_dedup", "select event_id, user_id, value from events")
def st_dedup(t):
    out = scratch(t.spark, "dedup")
    twice = events_stream(t).unionByName(events_stream(t))
    J.dedup(twice, ["event_id"], "1 day", f"{out}/data", f"{out}/cp")
    return t.spark.read.parquet(f"{out}/data").select("event_id", "user_id", "value")


TUMBLE = """select '{p}' as period, strftime(time_bucket(interval {p}, ts), '%Y-%m-%d %H:%M:%S.%f') as start, event_type, count(*) as n,
    cast(sum(cast(value as decimal(18,2))) as double) as total from events group by 2, 3"""


@query("st_tumbling", " union all ".join(TUMBLE.format(p=p) for p in ("5 minutes", "1 hour", "1 day")))
def st_tumbling(t):
    from voltlake.operators.catalog import union_all

    frames = []
    for p in ("5 minutes", "1 hour", "1 day"):
        out = scratch(t.spark, "tumbling")
        aggs = {"n": F.count("*"), "total": F.sum(F.col("value").cast("decimal(18,2)"))}
        J.tumbling(events_stream(t), p, ["event_type"], aggs, f"{out}/data", f"{out}/cp")
        rows = J.merged(t.spark, f"{out}/data", "start timestamp, event_type string, n long, total decimal(28,2)", ["start", "event_type"])
        frames.append(rows.select(
            F.lit(p).alias("period"), ts_text("start").alias("start"), "event_type", "n", F.col("total").cast("double").alias("total")))
    return union_all(frames)


@query("st_tumbling_closed", """select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, count(*) as n from events
    where date_trunc('day', ts) + interval 1 day <= (select max(ts) from events) - interval 1 day group by 1""")
def st_tumbling_closed(t):
    out = scratch(t.spark, "closed")
    J.closed_windows(events_stream(t), "1 day", "1 day", [], {"n": F.count("*")}, f"{out}/data", f"{out}/cp")
    return t.spark.read.parquet(f"{out}/data").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "n")


@query("st_sliding", """with h as (select unnest(generate_series(timestamp '2023-12-31 01:00:00', timestamp '2024-01-30 23:00:00', interval 1 hour)) as start)
    select strftime(h.start, '%Y-%m-%d %H:%M:%S.%f') as start, user_id % 5 as agent, count(*) as n
    from h join events e on e.ts >= h.start and e.ts < h.start + interval 24 hour where event_type = 'error' group by 1, 2 having count(*) >= 3""")
def st_sliding(t):
    out = scratch(t.spark, "sliding")
    errors = events_stream(t).where("event_type = 'error'").withColumn("agent", F.col("user_id") % 5)
    J.panes(errors, "1 hour", ["agent"], f"{out}/data", f"{out}/cp")
    counts = J.merged(t.spark, f"{out}/data", "start timestamp, agent long, n long", ["start", "agent"])
    return J.sliding(counts, 24 * 3600, 3600, ["agent"], least=3).select(ts_text("start").alias("start"), "agent", "n")


@query("st_budget_alert", """with d as (select strftime(ts, '%Y-%m-%d') as day, cast(sum(cast(value as decimal(18,2))) as double) as spend from events group by 1)
    select day, spend, case when spend / 14000 * 100 >= 100 then 'P1_halt' when spend / 14000 * 100 > 90 then 'P2_pause' else 'P3_warn' end as level from d where spend / 14000 * 100 > 80""")
def st_budget_alert(t):
    out = scratch(t.spark, "budget")
    J.budget_alerts(arrivals(t, out), "value", BUDGET, f"{out}/alerts", f"{out}/cp")
    last = t.spark.read.schema("start timestamp, spend decimal(28,2), level string, batch int").parquet(f"{out}/alerts").groupBy("start").agg(F.max(F.struct("spend", "level")).alias("r"))
    return last.select(F.date_format("start", "yyyy-MM-dd").alias("day"), F.col("r.spend").cast("double").alias("spend"), "r.level")


RECURRING = """select user_id, epoch_us(ts) as "at", n from (select *, count(*) over (partition by user_id order by epoch_us(ts) range between 86399999999 preceding and current row) as n
    from events where event_type = 'error') x where n >= 3"""


@query("st_recurring_error", RECURRING)
def st_recurring_error(t):
    out = scratch(t.spark, "recurring")
    J.recurring_errors(arrivals_in_order(t, out, "event_type = 'error'"), ["user_id"], f"{out}/alerts", f"{out}/cp")
    return J.merged(t.spark, f"{out}/alerts", "user_id long, at long, n long", ["user_id", "at"])


@query("st_recurring_error_recount", RECURRING)
def st_recurring_error_recount(t):
    out = scratch(t.spark, "recounted")
    J.recounted_errors(arrivals(t, out).where("event_type = 'error'"), ["user_id"], f"{out}/store", f"{out}/alerts", f"{out}/cp")
    return t.spark.read.schema("user_id long, at long, n long, recurring boolean, ds string").parquet(f"{out}/alerts").select("user_id", "at", "n")


@query("st_late_rows", "select event_id, user_id % 5 > 2 as late from events")
def st_late_rows(t):
    out = scratch(t.spark, "late")
    s = arrivals(t, out).withColumn("arrived", F.col("ts") + F.make_dt_interval(hours=(F.col("user_id") % 5).cast("int")))
    J.late_rows(s, "ts", "arrived", 2.0, f"{out}/ok", f"{out}/late", f"{out}/cp")
    read = lambda p, flag: t.spark.read.parquet(f"{out}/{p}").select("event_id", F.lit(flag).alias("late"))
    return read("ok", False).unionByName(read("late", True))


@query("st_online_features", """select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) x where r = 1""")
def st_online_features(t):
    out = scratch(t.spark, "online")
    J.online_features(arrivals(t, out), "user_id", ["event_type", "value"], ["ts", "event_id"], f"{out}/layers", f"{out}/cp")
    return J.read_online(t.spark, f"{out}/layers", "user_id").select("user_id", "event_id", "event_type", "value")


@query("st_dq_gate", """select 'not_null' as expectation, 'event_id' as "column", count(*) as evaluated, count(*) filter (event_id is null) as unexpected from events
    union all select 'between', 'value', count(*), count(*) filter (value < 0 or value > 400) from events
    union all select 'row_count', '*', count(*), 0 from events""")
def st_dq_gate(t):
    out = scratch(t.spark, "gate")
    suite = [Q.Expect("not_null", "event_id"), Q.Expect("between", "value", 0, 400), Q.Expect("row_count", low=1)]
    J.quality_gate(arrivals(t, out), suite, f"{out}/good", f"{out}/blocked", f"{out}/results", f"{out}/cp")
    return t.spark.read.parquet(f"{out}/results").groupBy("expectation", "column").agg(F.sum("evaluated").alias("evaluated"), F.sum("unexpected").alias("unexpected"))
