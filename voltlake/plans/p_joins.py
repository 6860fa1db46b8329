"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltlake.functions.scalars import day_text, minor, money, money_sum, r6
from voltlake.operators import joins as J
from voltlake.plans.p_cleanse import SILVER_SQL, silver
from voltlake.plans.registry import query


@query("etl_silver_to_gold", f"""with s as ({SILVER_SQL}),
    u as (select custkey, strftime(ts, '%Y-%m') as month, sum(cast(qty as decimal(18,2))) as usage,
          sum(cast(amount as decimal(18,4))) as amount from fx_usage group by 1, 2),
    v as (select c_custkey, any_value(c_mktsegment) as seg, any_value(ch.label) as label, any_value(ch.spend) as ltv
          from s left join fx_churn ch on s.c_custkey = ch.custkey group by 1)
    select v.seg as segment, u.month, count(*) as customers, cast(sum(u.usage) as double) as usage,
      round(cast(sum(u.amount) as double), 4) as amount, round(avg(v.label), 6) as churn_rate,
      cast(sum(v.ltv) as double) as lifetime_value
    from v join u on v.c_custkey = u.custkey group by 1, 2""")
def etl_silver_to_gold(t):
    monthly = t.fx_usage.groupBy("custkey", F.date_format("ts", "yyyy-MM").alias("month")).agg(
        F.sum(minor("qty")).alias("usage"), F.sum(minor("amount", 4)).alias("amount"))
    gold = silver(t).select(F.col("c_custkey").alias("custkey"), F.col("c_mktsegment").alias("segment")).join(
        t.fx_churn.select("custkey", "label", "spend"), "custkey", "left").join(monthly, "custkey")
    return gold.groupBy("segment", "month").agg(
        F.count("*").alias("customers"), (F.sum("usage").cast("double") / 100.0).alias("usage"),
        F.round(F.sum("amount").cast("double") / 10_000.0, 4).alias("amount"), r6(F.avg("label")).alias("churn_rate"),
        F.sum("spend").cast("double").alias("lifetime_value"))


@query("join_contracts", """select c.c_custkey, c.c_mktsegment, count(o.o_orderkey) as n_contracts,
    coalesce(cast(sum(cast(o.o_totalprice as decimal(18,2))) as double), 0) as contract_value
    from customer c left join orders o on c.c_custkey = o.o_custkey and o.o_orderstatus = 'P' group by 1, 2""")
def join_contracts(t):
    open_ = t.orders.where("o_orderstatus = 'P'").select("o_custkey", "o_orderkey", "o_totalprice")
    # contracts are summed before the join, so a customer with very many moves as one row per task
    c = open_.groupBy("o_custkey").agg(F.count("*").alias("n_contracts"), money_sum("o_totalprice").alias("contract_value"))
    return t.customer.join(c, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        "c_custkey", "c_mktsegment", F.coalesce("n_contracts", F.lit(0)).alias("n_contracts"),
        F.coalesce("contract_value", F.lit(0.0)).alias("contract_value"))


@query("join_features_labels", "select d.doc_id, d.lang, d.n_chars, l.quality, l.toxic from documents d join labels l on d.doc_id = l.doc_id")
def join_features_labels(t):
    return t.documents.select("doc_id", "lang", "n_chars").join(t.labels, "doc_id")


@query("join_point_in_time", """select p.event_id, p.user_id, f.event_id as feature_id, f.value as feature_value
    from (select * from events where event_type = 'purchase') p
    asof left join (select * from events where event_type = 'click') f on p.user_id = f.user_id and p.ts >= f.ts""")
def join_point_in_time(t):
    e = t.events
    labels = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    feats = e.where("event_type = 'click'").select(
        "user_id", F.col("ts").alias("feature_ts"), F.col("event_id").alias("feature_id"), F.col("value").alias("feature_value"))
    return J.point_in_time(labels, feats, ["user_id"], "ts", "feature_ts", ["feature_id", "feature_value"]).select(
        "event_id", "user_id", "feature_id", "feature_value")


@query("join_parity_full", """select coalesce(a.user_id, b.user_id) as user_id, coalesce(cast(a.ds as varchar), cast(b.ds as varchar)) as ds,
    a.user_id is not null as in_a, b.user_id is not null as in_b,
    coalesce(a.n_events = b.n_events, false) as n_events_equal, coalesce(a.total = b.total, false) as total_equal
    from fx_offline a full outer join fx_online b on a.user_id = b.user_id and a.ds = b.ds""")
def join_parity_full(t):
    return J.full_parity(t.fx_offline, t.fx_online, ["user_id", "ds"], ["n_events", "total"]).withColumn("ds", day_text("ds"))


@query("join_pred_actual", """select p.user_id, cast(p.ds as varchar) as ds, p.n_events as predicted, a.n_events as actual,
    abs(a.n_events - p.n_events) as abs_error
    from fx_offline p join fx_offline a on p.user_id = a.user_id and a.ds = p.ds + interval 7 day""")
def join_pred_actual(t):
    # the prediction for a day is the value one week before
    p = t.fx_offline.select("user_id", "ds", F.date_add("ds", 7).alias("target"), F.col("n_events").alias("predicted"))
    a = t.fx_offline.select("user_id", F.col("ds").alias("target"), F.col("n_events").alias("actual"))
    return p.join(a, ["user_id", "target"]).select(
        "user_id", day_text("ds").alias("ds"), "predicted", "actual", F.abs(F.col("actual") - F.col("predicted")).alias("abs_error"))


@query("join_broadcast_dim", """select r_name, n_name, count(*) as customers, cast(sum(cast(c_acctbal as decimal(18,2))) as double) as balance
    from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2""")
def join_broadcast_dim(t):
    return J.enrich_geography(t.customer, t.nation, t.region, "c_nationkey").groupBy("r_name", "n_name").agg(
        F.count("*").alias("customers"), money_sum("c_acctbal").alias("balance"))


@query("join_spend_channel", """with s as (select user_id % 4 as channel, strftime(ts, '%Y-%m-%d') as period, count(*) as signups
      from events where event_type = 'signup' group by 1, 2),
    m as (select user_id % 4 as channel, strftime(ts, '%Y-%m-%d') as period, cast(sum(cast(value as decimal(18,2))) as double) as spend
      from events where event_type = 'click' group by 1, 2)
    select s.channel, s.period, signups, spend, round(spend / signups, 6) as cost_per_signup
    from s left join m on s.channel = m.channel and s.period = m.period""")
def join_spend_channel(t):
    e = t.events.select((F.col("user_id") % 4).alias("channel"), day_text("ts").alias("period"), "event_type", "value")
    s = e.where("event_type = 'signup'").groupBy("channel", "period").agg(F.count("*").alias("signups"))
    m = e.where("event_type = 'click'").groupBy("channel", "period").agg(money_sum("value").alias("spend"))
    return J.spend_per_signup(s, m, ["channel", "period"])


@query("join_positions_prices", """select p_brand, o_orderstatus, cast(sum(cast(l_quantity as decimal(18,2))) as double) as position,
    round(cast(sum(cast(l_quantity * p_retailprice as decimal(18,4))) as double), 2) as market_value
    from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey group by 1, 2""")
def join_positions_prices(t):
    # positions are netted per (part, order status) first; only the netted rows meet the price table
    status = t.orders.select("o_orderkey", "o_orderstatus")
    held = t.lineitem.select("l_orderkey", "l_partkey", "l_quantity").join(status, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(
        "l_partkey", "o_orderstatus").agg(F.sum(money("l_quantity")).alias("q"))
    return held.join(t.part.select("p_partkey", "p_brand", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey")).groupBy(
        "p_brand", "o_orderstatus").agg(
        F.sum("q").cast("double").alias("position"),
        F.round(F.sum(J.position_value(F.col("q"), money("p_retailprice"))).cast("double"), 2).alias("market_value"))


SCENARIOS = {f"shift_{s:+d}": 1 + s / 100 for s in (-50, -40, -30, -20, -10, 0, 10, 20, 30, 40, 50)}


@query("join_scenarios_cross", f"""select o_orderstatus, scenario, round(cast(sum(cast(o_totalprice as decimal(18,2))) as double) * factor, 4) as value
    from orders cross join (values {', '.join(f"('{k}', {v!r}e0)" for k, v in SCENARIOS.items())}) s(scenario, factor)
    group by o_orderstatus, scenario, factor""")
def join_scenarios_cross(t):
    base = t.orders.groupBy("o_orderstatus").agg(money_sum("o_totalprice").alias("total"))
    return J.with_scenarios(base, SCENARIOS).select("o_orderstatus", "scenario", F.round(F.col("total") * F.col("factor"), 4).alias("value"))


BANDS = [("low", 0.0, 10.0), ("mid", 10.0, 30.0), ("high", 30.0, 45.0)]


@query("join_tariff_band", """select l_orderkey, l_linenumber, l_quantity, l_partkey, case when l_quantity < 10 then 'low' when l_quantity < 30 then 'mid'
    when l_quantity < 45 then 'high' end as band, l_quantity >= 45 as out_of_bounds from lineitem""")
def join_tariff_band(t):
    bands = t.spark.createDataFrame(BANDS, "band string, lo double, hi double")
    l = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey")
    return J.band(l, "l_quantity", bands, "lo", "hi", "band").withColumn("out_of_bounds", F.col("band").isNull())


@query("join_unused_anti", """select d.doc_id, d.source from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)""")
def join_unused_anti(t):
    return J.missing(t.documents.select("doc_id", "source"), t.labels, ["doc_id"])


@query("join_blocked_semi", """select d.doc_id, d.source from documents d where d.source in (
    select source from documents group by source having avg(case when n_chars between 20 and 20000 then 1e0 else 0e0 end) >= 0.95)""")
def join_blocked_semi(t):
    from voltlake.functions.scalars import share

    ok = t.documents.groupBy("source").agg(share(F.col("n_chars").between(20, 20000)).alias("s")).where("s >= 0.95")
    return J.gate(t.documents.select("doc_id", "source"), ok, "source")

