"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltlake.functions.scalars import day_text, money, money_sum, r4, r6, ts_text
from voltlake.operators import aggregates as A
from voltlake.operators import governance as G
from voltlake.operators.joins import enrich_geography
from voltlake.plans.registry import query
from voltlake.tables import day


@query("agg_monthly_usage", """select custkey, strftime(ts, '%Y-%m') as month, cast(sum(cast(qty as decimal(18,2))) as double) as usage,
    round(cast(sum(cast(amount as decimal(20,4))) as double), 6) as amount, count(*) as n from fx_usage group by 1, 2""")
def agg_monthly_usage(t):
    return A.monthly_usage(t.fx_usage, "custkey", "ts")


@query("agg_summary_table", """select coalesce(o_orderstatus, 'ALL') as o_orderstatus, coalesce(o_orderpriority, 'ALL') as o_orderpriority,
    count(*) as n, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total, round(avg(o_totalprice), 4) as mean
    from orders group by rollup(o_orderstatus, o_orderpriority)""")
def agg_summary_table(t):
    dims = ["o_orderstatus", "o_orderpriority"]
    return A.with_subtotals(t.orders, [dims, dims[:1], []], dims, [
        F.count("*").alias("n"), money_sum("o_totalprice").alias("total"), r4(F.avg("o_totalprice")).alias("mean")])


def customer_spend(t):
    """Spend, months active and segment per customer."""
    o = t.orders.groupBy("o_custkey").agg(
        F.sum(money("o_totalprice")).alias("spend"), F.count("*").alias("n_orders"),
        F.min("o_orderdate").alias("first_o"), F.max("o_orderdate").alias("last_o"))
    months = F.greatest(F.lit(1), F.floor(F.datediff(F.col("last_o").cast("date"), F.col("first_o").cast("date")) / 30).cast("int"))
    return o.join(t.customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")).select(
        "c_custkey", "c_mktsegment", F.col("spend").cast("double").alias("spend"), "n_orders", months.alias("months"), "first_o", "last_o")


SPEND_SQL = """select c_custkey, c_mktsegment, cast(spend as double) as spend, n_orders,
      greatest(1, cast(floor(datediff('day', first_o, last_o) / 30e0) as int)) as months, first_o, last_o
    from (select o_custkey, sum(cast(o_totalprice as decimal(18,2))) as spend, count(*) as n_orders, min(o_orderdate) as first_o,
          max(o_orderdate) as last_o from orders group by 1) o join customer on o_custkey = c_custkey"""


@query("agg_segment_profile", f"""select c_mktsegment as segment_id, count(*) as size, round(avg(spend / months), 4) as avg_monthly_spend,
    cast(count(*) over () as bigint) as num_segments from ({SPEND_SQL}) s group by 1""")
def agg_segment_profile(t):
    from pyspark.sql import Window as W

    g = customer_spend(t).groupBy(F.col("c_mktsegment").alias("segment_id")).agg(
        F.count("*").alias("size"), r4(F.avg(F.col("spend") / F.col("months"))).alias("avg_monthly_spend"))
    return g.withColumn("num_segments", F.count("*").over(W.partitionBy()))  # one row per segment


CLV = "(spend / n_orders) * (n_orders / greatest(1e0, datediff('day', first_o, last_o) / 365.25e0)) * 3e0"


@query("agg_clv", f"""select coalesce(c_mktsegment, 'ALL') as segment, count(*) as customers, round(avg({CLV}), 4) as avg_clv
    from ({SPEND_SQL}) s group by grouping sets ((c_mktsegment), ())""")
def agg_clv(t):
    from voltlake.operators.customers import lifetime_value

    v = lifetime_value(customer_spend(t))
    return A.with_subtotals(v.withColumnRenamed("c_mktsegment", "segment"), [["segment"], []], ["segment"], [
        F.count("*").alias("customers"), r4(F.avg("clv")).alias("avg_clv")])


@query("agg_signups_channel", """with e as (select cast(user_id % 4 as varchar) as channel, r_name as region,
      cast(date_trunc('week', ts) as varchar)[1:10] as week, strftime(ts, '%Y-%m') as month
      from events join customer on user_id = c_custkey join nation on c_nationkey = n_nationkey
      join region on n_regionkey = r_regionkey where event_type = 'signup')
    select coalesce(channel, 'ALL') as channel, coalesce(region, 'ALL') as region, coalesce(week, 'ALL') as week,
      coalesce(month, 'ALL') as month, count(*) as signups
    from e group by grouping sets ((channel, region, week), (channel, region, month), (channel, month), ())""")
def agg_signups_channel(t):
    # sign-ups are counted per user and week first, so a very active user is a few rows in the join
    s = t.events.where("event_type = 'signup'").groupBy(
        "user_id", day_text(F.date_trunc("week", "ts")).alias("week"), F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    c = t.customer.select("c_custkey", "c_nationkey")
    e = enrich_geography(s.join(c, F.col("user_id") == F.col("c_custkey")), t.nation, t.region, "c_nationkey").select(
        (F.col("user_id") % 4).cast("string").alias("channel"), F.col("r_name").alias("region"), "week", "month", "n")
    dims = ["channel", "region", "week", "month"]
    levels = [["channel", "region", "week"], ["channel", "region", "month"], ["channel", "month"], []]
    return A.with_subtotals(e, levels, dims, [F.sum("n").alias("signups")])


@query("agg_high_risk", """select count(*) as predictions_count, cast(count(*) filter (where score >= 0.7) as bigint) as high_risk_count,
    round(100 * avg(case when score >= 0.7 then 1e0 else 0e0 end), 6) as high_risk_pct, round(avg(label), 6) as churn_rate from fx_churn""")
def agg_high_risk(t):
    return A.high_risk(t.fx_churn, "score", "label", 0.7)


@query("agg_churn_trend", """select cast(d.d as varchar)[1:10] as d, count(e.event_id) as n,
    round(avg(case when e.event_id is null then null when event_type = 'error' then 1e0 else 0e0 end), 6) as rate
    from (select unnest(generate_series(timestamp '2024-01-06', timestamp '2024-02-04', interval 1 day)) as d) d
    left join events e on cast(e.ts as date) = cast(d.d as date) group by 1""")
def agg_churn_trend(t):
    e = t.events.select(day("ts").alias("ds"), "event_type")
    return A.daily_rate(e, "ds", F.col("event_type") == "error", "2024-02-04", 30).withColumn("d", day_text("d"))


@query("agg_churn_by_segment", """select c_mktsegment as segment, count(*) as n, round(avg(label), 6) as churn_rate
    from fx_churn join customer on custkey = c_custkey group by 1""")
def agg_churn_by_segment(t):
    return t.fx_churn.join(t.customer.select("c_custkey", F.col("c_mktsegment").alias("segment")), F.col("custkey") == F.col("c_custkey")).groupBy(
        "segment").agg(F.count("*").alias("n"), r6(F.avg("label")).alias("churn_rate"))


@query("agg_top_driver", """with i as (select 'recency' as feature, abs(corr(recency, label)) as importance from fx_churn
      union all select 'orders', abs(corr(n, label)) from fx_churn
      union all select 'spend', abs(corr(cast(spend as double), label)) from fx_churn)
    select arg_max(feature, importance) as feature, round(max(importance), 6) as importance from i""")
def agg_top_driver(t):
    from voltlake.operators.reports import importances, top_driver

    return top_driver(importances(t.fx_churn.withColumnRenamed("n", "orders"), ["recency", "orders", "spend"], "label"))


@query("agg_row_stats", """select count(*) as row_count, 1e0 as completeness, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') as last_modified,
    round((epoch_us(timestamp '2024-01-31') - epoch_us(max(ts))) / 3.6e9, 6) as freshness_hours from events""")
def agg_row_stats(t):
    return A.row_stats(t.events, "ts", "2024-01-31 00:00:00").withColumn("last_modified", ts_text("last_modified"))


@query("agg_profile", """select 'o_custkey' as "column", cast(count(*) filter (where o_custkey is null) as bigint) as nulls,
      count(distinct o_custkey) as "distinct", cast(min(o_custkey) as varchar) as "min", cast(max(o_custkey) as varchar) as "max",
      round(avg(o_custkey), 6) as mean from orders
    union all select 'o_totalprice', count(*) filter (where o_totalprice is null), count(distinct o_totalprice),
      cast(min(o_totalprice) as varchar), cast(max(o_totalprice) as varchar), round(avg(o_totalprice), 6) from orders
    union all select 'o_orderstatus', count(*) filter (where o_orderstatus is null), count(distinct o_orderstatus),
      min(o_orderstatus), max(o_orderstatus), null from orders
    union all select 'o_orderpriority', count(*) filter (where o_orderpriority is null), count(distinct o_orderpriority),
      min(o_orderpriority), max(o_orderpriority), null from orders""")
def agg_profile(t):
    return A.profile(t.orders, ["o_custkey", "o_totalprice"], ["o_orderstatus", "o_orderpriority"])


@query("agg_catalog_coverage", """select count(*) as expected, count(l.doc_id) as present, round(count(l.doc_id) / cast(count(*) as double), 6) as coverage
    from documents d left join labels l on d.doc_id = l.doc_id""")
def agg_catalog_coverage(t):
    return G.coverage(t.documents, t.labels, "doc_id")

