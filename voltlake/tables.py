"""Input tables with declared schemas, and the derived views the plans run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlake.session import prepare

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "conversations": "conv_id long, turn long, role string, text string",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
}

CHURN_CUTOFF = "2000-12-31"
CHURN_HORIZON_DAYS = 180


class Lake:
    """One data folder: ``lake.orders`` is a scan, ``lake.fx_usage`` a derived view."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = prepare(spark)
        self.path = path.rstrip("/")

    def file(self, name: str) -> str:
        return f"{self.path}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name in SCHEMAS:
            return self.spark.read.schema(SCHEMAS[name]).parquet(self.file(name))
        if name in VIEWS:
            return VIEWS[name](self)
        raise AttributeError(name)


def day(c: str):
    return F.col(c).cast("date")


def micros(c: str):
    """Epoch microseconds of a zone-less timestamp."""
    return F.unix_micros(F.col(c).cast("timestamp"))


def _customers(t: Lake) -> DataFrame:
    at = F.when(F.col("c_custkey") % 20 == 0, "").otherwise("@example.com")
    return t.customer.select(
        "c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal",
        F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), at).alias("email"),
        (F.col("c_custkey") % 50 == 0).alias("is_test"),
    )


def _usage(t: Lake) -> DataFrame:
    o = t.orders.select("o_orderkey", F.col("o_custkey").alias("custkey"))
    l = t.lineitem.select(
        "l_orderkey", F.col("l_shipdate").alias("ts"), F.col("l_quantity").alias("qty"),
        (F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))).alias("amount"),
    )
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("custkey", "ts", "qty", "amount")


def _task_log(t: Lake) -> DataFrame:
    failed = F.col("event_type") == "error"
    return t.events.select(
        F.col("event_id").alias("run_id"), "ts", (F.col("user_id") % 5).alias("agent"), "user_id",
        F.when(failed, "FAILED").otherwise("COMPLETED").alias("status"), F.col("value").alias("latency_ms"),
    )


def _cost_log(t: Lake) -> DataFrame:
    return t.events.select(
        "event_id", "ts", day("ts").alias("ds"), (F.col("user_id") % 5).alias("agent"),
        F.col("event_type").alias("resource_type"), F.col("value").cast("decimal(18,2)").alias("cost_gbp"),
    )


def _churn(t: Lake) -> DataFrame:
    from voltlake.operators.models import churn_base

    return churn_base(t.orders, CHURN_CUTOFF, CHURN_HORIZON_DAYS)


def _ab(t: Lake) -> DataFrame:
    hit = (F.col("event_type") == "purchase").cast("int")
    return (
        t.events.groupBy("user_id", day("ts").alias("ds")).agg(F.max(hit).alias("converted"))
        .select("user_id", "ds", (F.col("user_id") % 3).alias("arm"), "converted")
    )


def _pnl(t: Lake) -> DataFrame:
    from pyspark.sql import Window as W

    # One row per calendar day, so the ordered window below stays small whatever the order count.
    daily = t.orders.groupBy(F.col("o_orderdate").alias("ds")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))
    w = W.orderBy("ds")
    return daily.select("ds", (F.col("total") - F.lag("total").over(w)).cast("double").alias("pnl"))


def _offline(t: Lake) -> DataFrame:
    return t.events.groupBy("user_id", day("ts").alias("ds")).agg(
        F.count("*").alias("n_events"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"),
        F.max("ts").alias("event_time"),
    )


def _online(t: Lake) -> DataFrame:
    off = _offline(t)
    latest = off.groupBy("user_id").agg(
        F.max(F.struct("event_time", "ds", "n_events", "total")).alias("r"))
    shift = F.when(F.col("user_id") % 10 == 0, 1).otherwise(0)
    return latest.select("user_id", "r.ds", (F.col("r.n_events") + shift).alias("n_events"), "r.total", "r.event_time")


def _status(t: Lake) -> DataFrame:
    return t.orders.select(
        F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("seq"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("ts"),
    )


VIEWS = {
    "fx_customers": _customers, "fx_usage": _usage, "fx_task_log": _task_log, "fx_cost_log": _cost_log,
    "fx_churn": _churn, "fx_ab": _ab, "fx_pnl": _pnl, "fx_offline": _offline, "fx_online": _online,
    "fx_status_history": _status,
}

# The same views for the SQL oracle.
VIEW_SQL = {
    "fx_customers": """select c_custkey, c_nationkey, c_mktsegment, c_acctbal,
        concat(lower(replace(c_name,'#','.')), case when c_custkey % 20 = 0 then '' else '@example.com' end) as email,
        c_custkey % 50 = 0 as is_test from customer""",
    "fx_usage": """select o.o_custkey as custkey, l.l_shipdate as ts, l.l_quantity as qty,
        l.l_extendedprice * (1e0 - l.l_discount) as amount
        from lineitem l join orders o on l.l_orderkey = o.o_orderkey""",
    "fx_task_log": """select event_id as run_id, ts, user_id % 5 as agent, user_id,
        case when event_type = 'error' then 'FAILED' else 'COMPLETED' end as status, value as latency_ms from events""",
    "fx_cost_log": """select event_id, ts, cast(ts as date) as ds, user_id % 5 as agent, event_type as resource_type,
        cast(value as decimal(18,2)) as cost_gbp from events""",
    "fx_churn": """select b.k as custkey, b.n, b.spend, datediff('day', b.last_o, timestamp '2000-12-31') as recency,
        case when f.k is null then 1 else 0 end as label,
        datediff('day', b.last_o, timestamp '2000-12-31')
          / (datediff('day', b.last_o, timestamp '2000-12-31') + 180e0) as score
        from (select o_custkey as k, max(o_orderdate) as last_o, min(o_orderdate) as first_o, count(*) as n,
                     sum(cast(o_totalprice as decimal(18,2))) as spend
              from orders where o_orderdate <= timestamp '2000-12-31' group by o_custkey) b
        left join (select distinct o_custkey as k from orders
              where o_orderdate > timestamp '2000-12-31' and o_orderdate <= timestamp '2001-06-29') f on b.k = f.k""",
    "fx_ab": """select user_id, cast(ts as date) as ds, user_id % 3 as arm,
        max(case when event_type = 'purchase' then 1 else 0 end) as converted
        from events group by user_id, cast(ts as date)""",
    "fx_pnl": """select ds, cast(total - lag(total) over (order by ds) as double) as pnl
        from (select o_orderdate as ds, sum(cast(o_totalprice as decimal(18,2))) as total from orders group by o_orderdate) t""",
    "fx_offline": """select user_id, cast(ts as date) as ds, count(*) as n_events,
        sum(cast(value as decimal(18,2))) as total, max(ts) as event_time
        from events group by user_id, cast(ts as date)""",
    "fx_online": """select user_id, ds, n_events + case when user_id % 10 = 0 then 1 else 0 end as n_events, total, event_time
        from (select t.*, row_number() over (partition by user_id order by event_time desc) as r
              from (select user_id, cast(ts as date) as ds, count(*) as n_events,
                           sum(cast(value as decimal(18,2))) as total, max(ts) as event_time
                    from events group by user_id, cast(ts as date)) t) x where r = 1""",
    "fx_status_history": """select o_custkey as custkey, o_orderkey as seq, o_orderstatus as status, o_orderdate as ts from orders""",
}
