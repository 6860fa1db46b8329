"""History, windows, top rows and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltlake.functions.scalars import day_text, ts_text
from voltlake.operators import windows as W
from voltlake.plans.registry import query

SCD2_SQL = """select custkey, status, strftime(ts, '%Y-%m-%d') as valid_from, seq,
      strftime(lead(ts) over (partition by custkey order by ts, seq), '%Y-%m-%d') as valid_to,
      lead(ts) over (partition by custkey order by ts, seq) is null as is_current
    from (select *, lag(status) over (partition by custkey order by ts, seq) as prev,
          row_number() over (partition by custkey order by ts, seq) as r from fx_status_history) h
    where r = 1 or status is distinct from prev"""


def shown(df):
    return df.select("custkey", "status", day_text("valid_from").alias("valid_from"), "seq", day_text("valid_to").alias("valid_to"), "is_current")


@query("win_scd2", SCD2_SQL)
def win_scd2(t):
    return shown(W.scd2(t.fx_status_history, "custkey", ["status"], "ts", "seq"))


@query("win_scd2_merge", SCD2_SQL)
def win_scd2_merge(t):
    h = t.fx_status_history
    cut = F.lit("2001-06-01").cast("timestamp_ntz")
    base = W.scd2(h.where(F.col("ts") < cut), "custkey", ["status"], "ts", "seq")
    return shown(W.scd2_merge(base, h.where(F.col("ts") >= cut), "custkey", ["status"], "ts", "seq"))


@query("win_sliding_30d", """select distinct o_custkey, epoch_us(o_orderdate) as "at", count(*) over w as n,
      cast(sum(cast(o_totalprice as decimal(18,2))) over w as double) as total
    from orders window w as (partition by o_custkey order by o_orderdate range between interval 30 day preceding and current row)""")
def win_sliding_30d(t):
    return W.sliding(t.orders, ["o_custkey"], "o_orderdate", "o_totalprice", 30 * 86400).withColumn("total", F.col("total").cast("double"))


@query("win_lag_features", """select o_orderkey, o_custkey, cast(row_number() over w as bigint) as order_no,
    datediff('day', lag(o_orderdate) over w, o_orderdate) as gap_days, lag(o_totalprice) over w as prev_total
    from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)""")
def win_lag_features(t):
    return W.order_features(t.orders, "o_custkey", "o_orderdate", "o_orderkey").select(
        "o_orderkey", "o_custkey", "order_no", "gap_days", "prev_total")


@query("win_lift_deciles", """with d as (select ntile(10) over (order by -score, custkey) as decile, label from fx_churn),
    g as (select cast(decile as int) as decile, count(*) as n, cast(sum(label) as bigint) as positives from d group by 1)
    select decile, n, positives, round(positives / cast(n as double), 6) as response,
      round(sum(positives) over (order by decile) / cast(sum(positives) over () as double), 6) as gain,
      round((positives / cast(n as double)) / (sum(positives) over () / cast(sum(n) over () as double)), 6) as lift from g""")
def win_lift_deciles(t):
    return W.lift_deciles(t.fx_churn, "score", "label", "custkey")


@query("win_last_n_messages", """select conv_id, turn, role, text from
    (select *, row_number() over (partition by conv_id order by turn desc) as r from conversations) x where r <= 3""")
def win_last_n_messages(t):
    return W.last_n(t.conversations, "conv_id", "turn", 3)


@query("win_recent_errors", """select agent, run_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as ts from
    (select *, row_number() over (partition by agent order by ts desc) as r from fx_task_log where status = 'FAILED') x where r <= 5""")
def win_recent_errors(t):
    e = t.fx_task_log.where("status = 'FAILED'").select("agent", "run_id", "ts")
    return W.last_n(e, "agent", "ts", 5).withColumn("ts", ts_text("ts"))


@query("topk_errors", """select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as ts, user_id, value from events
    where event_type = 'error' order by events.ts desc, event_id limit 20""")
def topk_errors(t):
    e = t.events.where("event_type = 'error'").select("event_id", "ts", "user_id", "value")
    return W.top_n(e, [F.desc("ts"), "event_id"], 20).withColumn("ts", ts_text("ts"))


def lineage_edges(t):
    """Lineage events, one per order: bronze to silver, silver to gold, and now and then gold back to bronze."""
    c = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment")
    bronze = F.format_string("s3://lake/bronze/%s/", F.lower("c_mktsegment"))
    silver = F.format_string("s3://lake/silver/nation_%d/", "c_nationkey")
    gold = F.format_string("s3://lake/gold/status_%s/", F.lower("o_orderstatus"))
    even, back = F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 1000 == 999
    return t.orders.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("event_no"), F.when(back, gold).when(even, bronze).otherwise(silver).alias("source_uri"),
        F.when(back, bronze).when(even, silver).otherwise(gold).alias("target_uri"),
        F.substring("o_orderpriority", 1, 1).alias("transformation"), F.col("o_orderdate").alias("ts"))


EDGES_SQL = """select o_orderkey as event_no,
      case when o_orderkey % 1000 = 999 then g when o_orderkey % 2 = 0 then b else s end as source_uri,
      case when o_orderkey % 1000 = 999 then b when o_orderkey % 2 = 0 then s else g end as target_uri,
      left(o_orderpriority, 1) as transformation, o_orderdate as ts
    from (select *, concat('s3://lake/bronze/', lower(c_mktsegment), '/') as b, concat('s3://lake/silver/nation_', c_nationkey, '/') as s,
            concat('s3://lake/gold/status_', lower(o_orderstatus), '/') as g
          from orders join customer on o_custkey = c_custkey) x"""

NODES_SQL = f"""with e as ({EDGES_SQL}),
    n as (select source_uri as id, event_no, 0 as side from e union all select target_uri, event_no, 1 from e)
    select id, event_no as first_event, side, 'dataset' as type, case when contains(id, '/bronze/') then 'bronze'
      when contains(id, '/silver/') then 'silver' when contains(id, '/gold/') then 'gold' else 'unknown' end as layer
    from (select *, row_number() over (partition by id order by event_no, side) as r from n) x where r = 1"""


@query("set_union_distinct_nodes", NODES_SQL)
def set_union_distinct_nodes(t):
    from voltlake.operators.catalog import lineage_nodes

    return lineage_nodes(lineage_edges(t), "event_no")


@query("set_union_backfill", """select strftime(ds, '%Y-%m-%d') as ds, user_id, n_events, cast(total as double) as total from fx_offline
    where ds between date '2024-01-05' and date '2024-01-12'""")
def set_union_backfill(t):
    spine = F.broadcast(W.day_spine(t.events, "2024-01-05", "2024-01-12"))
    return t.fx_offline.join(spine, "ds").select(day_text("ds").alias("ds"), "user_id", "n_events", F.col("total").cast("double").alias("total"))


@query("set_intersect_online", """select user_id from fx_online where n_events > 2 intersect select user_id from fx_offline where ds = date '2024-01-15'""")
def set_intersect_online(t):
    return t.fx_online.where("n_events > 2").select("user_id").intersect(
        t.fx_offline.where(F.col("ds") == F.lit("2024-01-15").cast("date")).select("user_id"))

