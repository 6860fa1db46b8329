"""Feature store."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltlake.functions.scalars import day_text, ds_text, ts_text
from voltlake.operators import features as S
from voltlake.plans.registry import query
from voltlake.session import scratch

AS_OF = "2002-01-01"


def computed(t):
    return S.customer_features(t.customer, t.orders, t.events, t.nation, t.region, AS_OF)


FEATURES_SQL = """select cast(c_custkey as varchar) as customer_id, '2002-01-01' as event_time, 18 + c_custkey % 70 as age,
      cast(datediff('day', first, timestamp '2002-01-01') as bigint) as tenure_days, cast(spend as double) as lifetime_value,
      cast(datediff('day', last, timestamp '2002-01-01') as bigint) as last_purchase_days,
      round(cast(spend as double) / greatest(1, datesub('month', first, timestamp '2002-01-01')), 4) as avg_monthly_spend,
      coalesce(tickets, 0) as num_support_tickets, r_name as region, c_mktsegment as plan_type
    from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
    left join (select o_custkey, sum(cast(o_totalprice as decimal(18,2))) as spend, min(o_orderdate) as first, max(o_orderdate) as last
               from orders where o_orderdate <= timestamp '2002-01-01' group by 1) o on o_custkey = c_custkey
    left join (select user_id, count(*) as tickets from events where event_type = 'error' group by 1) e on user_id = c_custkey"""


@query("fs_create_group", FEATURES_SQL)
def fs_create_group(t):
    empty = t.spark.createDataFrame([], S.group_schema(S.CUSTOMER_GROUP))
    return empty.unionByName(S.conform(computed(t), S.CUSTOMER_GROUP))


@query("fs_compute", f"select * exclude (event_time) from ({FEATURES_SQL}) f")
def fs_compute(t):
    return S.conform(computed(t), S.CUSTOMER_GROUP).drop("event_time")


LATEST_SQL = """select user_id, cast(ds as varchar) as ds, n_events, cast(total as double) as total, strftime(event_time, '%Y-%m-%d %H:%M:%S.%f') as event_time
    from (select *, row_number() over (partition by user_id order by event_time desc) as r from fx_offline) x where r = 1"""


def shown(df):
    return df.select("user_id", day_text("ds").alias("ds"), "n_events", F.col("total").cast("double").alias("total"), ts_text("event_time").alias("event_time"))


@query("fs_ingest", LATEST_SQL)
def fs_ingest(t):
    from voltlake.sources.files import write_partitioned

    out = scratch(t.spark, "offline")
    # two loads land in the history by day; the online store is its latest row per key
    for part in ("2024-01-01 <= day and day < 2024-01-16", "rest"):
        cut = F.col("ds") < F.lit("2024-01-16").cast("date")
        batch = t.fx_offline.where(cut if part != "rest" else ~cut).withColumnRenamed("ds", "feature_date")
        write_partitioned(batch.withColumn("ds", ds_text("feature_date")), out)
    history = t.spark.read.parquet(out).drop("ds").withColumnRenamed("feature_date", "ds")
    return shown(S.online(history, "user_id", "event_time"))


@query("fs_backfill", """with d as (select unnest(generate_series(timestamp '2024-01-10', timestamp '2024-01-17', interval 1 day)) as ds),
    u as (select distinct user_id from fx_offline)
    select u.user_id, strftime(d.ds, '%Y-%m-%d') as ds, cast(sum(o.n_events) as bigint) as n_events, cast(sum(o.total) as double) as total
    from u cross join d join fx_offline o on o.user_id = u.user_id and o.ds <= d.ds group by 1, 2""")
def fs_backfill(t):
    return S.backfill(t.fx_offline, "user_id", "2024-01-10", "2024-01-17").select(
        "user_id", day_text("ds").alias("ds"), "n_events", F.col("total").cast("double").alias("total"))


def sample_ids(t):
    return t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))


@query("fs_get_online", """select user_id, cast(ds as varchar) as ds, n_events, cast(total as double) as total, strftime(event_time, '%Y-%m-%d %H:%M:%S.%f') as event_time
    from fx_online where user_id in (select c_custkey from customer where c_mktsegment = 'BUILDING')""")
def fs_get_online(t):
    return shown(S.only(t.fx_online, sample_ids(t), "user_id"))


@query("fs_get_offline", """select user_id, cast(ds as varchar) as ds, n_events, cast(total as double) as total, strftime(event_time, '%Y-%m-%d %H:%M:%S.%f') as event_time
    from fx_offline where user_id in (select c_custkey from customer where c_mktsegment = 'BUILDING')""")
def fs_get_offline(t):
    return shown(S.only(t.fx_offline, sample_ids(t), "user_id"))


PARITY = """(select coalesce(a.n_events = b.n_events, false) as p, coalesce(a.total = b.total, false) as q
      from (select *, row_number() over (partition by user_id order by event_time desc) as r from fx_offline) a
      full outer join fx_online b on a.user_id = b.user_id where a.r = 1 or a.r is null) x"""


@query("fs_parity", f"""select count(*) as keys, round(sum(p::int + q::int) / (2e0 * count(*)), 6) as parity,
    sum(p::int + q::int) / (2e0 * count(*)) >= 0.99 as passed, sum(p::int + q::int) / (2e0 * count(*)) >= 0.999 as contract_passed from {PARITY}""")
def fs_parity(t):
    return parity(t)


def parity(t):
    return S.parity(S.online(t.fx_offline, "user_id", "event_time"), t.fx_online, ["user_id"], ["n_events", "total"])


@query("fs_freshness", """select round((epoch_us(timestamp '2024-01-31') - epoch_us(max(event_time))) / 3.6e9, 6) as hours,
    (epoch_us(timestamp '2024-01-31') - epoch_us(max(event_time))) / 3.6e9 <= 1 as passed from fx_offline""")
def fs_freshness(t):
    return S.freshness(t.fx_offline, "event_time", "2024-01-31 00:00:00")


def gaps(t):
    """Features with gaps: totals below 20 are treated as not delivered."""
    return t.fx_offline.withColumn("total", F.when(F.col("total") >= 20, F.col("total")))


@query("fs_completeness", """select round(1 - sum(case when total < 20 then 1 else 0 end) / (3e0 * count(*)), 6) as completeness,
    1 - sum(case when total < 20 then 1 else 0 end) / (3e0 * count(*)) >= 0.99 as passed from fx_offline""")
def fs_completeness(t):
    return S.completeness(gaps(t), ["n_events", "total", "event_time"])


@query("fs_validate", f"""with f as (select (epoch_us(timestamp '2024-01-31') - epoch_us(max(event_time))) / 3.6e9 <= 1 as ok from fx_offline),
    c as (select 1 - sum(case when total < 20 then 1 else 0 end) / (3e0 * count(*)) >= 0.99 as ok from fx_offline),
    p as (select sum(p::int + q::int) / (2e0 * count(*)) >= 0.99 as ok from {PARITY})
    select f.ok as freshness_passed, c.ok as completeness_passed, p.ok as parity_passed, f.ok and c.ok and p.ok as valid from f, c, p""")
def fs_validate(t):
    return S.validation({
        "freshness": S.freshness(t.fx_offline, "event_time", "2024-01-31 00:00:00"),
        "completeness": S.completeness(gaps(t), ["n_events", "total", "event_time"]), "parity": parity(t)})


@query("fs_cached_fallback", """select u.user_id, coalesce(n.n_events, case when age <= 24 then o.n_events end) as n_events,
      case when n.n_events is not null then 'new' when age <= 24 then 'cached' else 'missing' end as origin
    from (select c_custkey as user_id from customer) u
    left join (select user_id, n_events from fx_offline where ds = date '2024-01-30' and n_events > 2) n on n.user_id = u.user_id
    left join (select user_id, n_events, (epoch_us(timestamp '2024-01-31') - epoch_us(event_time)) / 3.6e9 as age from fx_online) o on o.user_id = u.user_id""")
def fs_cached_fallback(t):
    ids = t.customer.select(F.col("c_custkey").alias("user_id"))
    fresh = t.fx_offline.where((F.col("ds") == F.lit("2024-01-30").cast("date")) & (F.col("n_events") > 2))
    return S.with_fallback(ids, fresh, t.fx_online, "user_id", "n_events", "event_time", "2024-01-31 00:00:00")
