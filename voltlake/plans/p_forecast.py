"""Forecasts, anomalies, segments and lifetime value."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltlake.functions.scalars import day_text, r4, r6
from voltlake.operators import anomaly as N
from voltlake.operators import customers as C
from voltlake.operators import forecast as P
from voltlake.plans.p_aggs import CLV, SPEND_SQL, customer_spend
from voltlake.plans.registry import query

LOAD_AS_OF = "2001-05-31"


def model_sql(series, as_of, horizon, key=None):
    """CTEs ``hist``, ``mod`` and ``fc`` over a series (key, ds, y)."""
    k = key or "one"
    return f"""s0 as ({series}),
    days as (select cast(unnest(generate_series(timestamp '{as_of}' - interval 27 day, timestamp '{as_of}', interval 1 day)) as date) as ds),
    ks as (select distinct {k} from s0 where ds > date '{as_of}' - interval 28 day and ds <= date '{as_of}'),
    hist as (select ks.{k}, d.ds, coalesce(s0.y, 0) as y, dayofweek(d.ds) as wd from ks cross join days d left join s0 on s0.{k} = ks.{k} and s0.ds = d.ds),
    wdm as (select {k}, wd, avg(y) as m from hist group by 1, 2),
    lev as (select {k}, avg(y) as level from hist group by 1),
    sdv as (select h.{k}, sqrt(sum((y - m) * (y - m)) / (count(*) - 1)) as sd from hist h join wdm on wdm.{k} = h.{k} and wdm.wd = h.wd group by 1),
    fc as (select ks.{k}, cast(f.ds as date) as ds, m as yhat, sd from ks
      cross join (select unnest(generate_series(timestamp '{as_of}' + interval 1 day, timestamp '{as_of}' + interval {horizon} day, interval 1 day)) as ds) f
      join wdm on wdm.{k} = ks.{k} and wdm.wd = dayofweek(f.ds) join sdv on sdv.{k} = ks.{k})"""


SIGNUPS = "select cast(user_id % 4 as varchar) as channel, cast(ts as date) as ds, cast(count(*) as double) as y from events where event_type = 'signup' group by 1, 2"
LOAD = "select 1 as one, cast(ts as date) as ds, cast(sum(cast(qty as decimal(18,2))) as double) as y from fx_usage group by 2"


@query("fc_acquisition", f"""with {model_sql(SIGNUPS, '2024-01-30', 30, 'channel')}
    select coalesce(channel, 'ALL') as channel, round(sum(yhat), 4) as next_30_days from fc group by grouping sets ((channel), ())""")
def fc_acquisition(t):
    from voltlake.operators.aggregates import with_subtotals

    e = t.events.where("event_type = 'signup'").withColumn("channel", (F.col("user_id") % 4).cast("string"))
    f = P.predict(P.model(P.daily_counts(e, ["channel"], "ts"), ["channel"], "2024-01-30"), ["channel"], "2024-01-30", 30)
    return with_subtotals(f, [["channel"], []], ["channel"], [r4(F.sum("yhat")).alias("next_30_days")])


def load_series(t):
    return P.daily_counts(t.fx_usage, [], "ts", F.col("qty").cast("decimal(18,2)"))


def load_forecast(t):
    return P.predict(P.model(load_series(t), [], LOAD_AS_OF), [], LOAD_AS_OF, 30)


@query("fc_load", f"""with {model_sql(LOAD, LOAD_AS_OF, 30)} select round(sum(yhat), 4) as total, round(max(yhat), 4) as peak,
    round(sum(yhat) - 1.96e0 * max(sd) * sqrt(30e0), 4) as lo95, round(sum(yhat) + 1.96e0 * max(sd) * sqrt(30e0), 4) as hi95 from fc""")
def fc_load(t):
    return P.total(load_forecast(t), [], 30)


@query("fc_load_profile", """select c_mktsegment as segment, cast(hour(ts) * 2 + minute(ts) // 30 as int) as slot, dayofweek(ts) in (0, 6) as weekend,
    count(*) as n, round(cast(sum(cast(value as decimal(18,2))) as double) / count(*), 6) as mean_load from events join customer on user_id = c_custkey group by 1, 2, 3""")
def fc_load_profile(t):
    slot = (F.hour("ts") * 2 + F.floor(F.minute("ts") / 30)).cast("int")
    # half-hourly sums per user first: the join then sees users and slots instead of readings
    g = t.events.groupBy("user_id", slot.alias("slot"), F.dayofweek("ts").isin(1, 7).alias("weekend")).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("v"))
    j = g.join(t.customer.select("c_custkey", F.col("c_mktsegment").alias("segment")), F.col("user_id") == F.col("c_custkey"))
    return j.groupBy("segment", "slot", "weekend").agg(F.sum("n").alias("n"), r6(F.sum("v").cast("double") / F.sum("n")).alias("mean_load"))


BT = f"""{model_sql(LOAD, LOAD_AS_OF, 30)},
    bt as (select fc.ds, yhat, sd, a.y, n.y as naive from fc join s0 a on a.ds = fc.ds left join s0 n on n.ds = fc.ds - interval 7 day)"""


def load_backtest(t):
    return P.with_actuals(load_forecast(t), load_series(t), [])


@query("fc_metrics", f"""with {BT} select count(*) as n, round(avg(abs(yhat - y)), 6) as mae, round(sqrt(avg((yhat - y) * (yhat - y))), 6) as rmse,
    round(avg(case when y <> 0 then abs((yhat - y) / y) end), 6) as mape, round(sum(yhat - y) / sum(y), 6) as bias,
    round(avg(case when abs(yhat - y) <= 1.281552e0 * sd then 1e0 else 0e0 end), 6) as coverage_80, round(avg(0.5e0 * abs(yhat - y)), 6) as pinball_50,
    round(1 - avg(abs(yhat - y)) / avg(abs(naive - y)), 6) as skill from bt""")
def fc_metrics(t):
    return P.metrics(load_backtest(t), [])


@query("fc_naive_fallback", f"""with {model_sql(SIGNUPS, '2024-01-30', 30, 'channel')},
    l as (select channel, dayofweek(ds) as wd, arg_max(y, ds) as last_wd from s0 where dayofweek(ds) <> 3 group by 1, 2),
    m as (select channel, avg(y) as mean from hist group by 1)
    select fc.channel, strftime(fc.ds, '%Y-%m-%d') as ds, round(coalesce(case when day(fc.ds) % 3 = 0 then yhat end, last_wd, mean), 6) as yhat,
      case when day(fc.ds) % 3 = 0 then 'model' when last_wd is not null then 'weekday' else 'mean' end as origin
    from fc left join l on l.channel = fc.channel and l.wd = dayofweek(fc.ds) join m on m.channel = fc.channel""")
def fc_naive_fallback(t):
    e = t.events.where("event_type = 'signup'").withColumn("channel", (F.col("user_id") % 4).cast("string"))
    s = P.daily_counts(e, ["channel"], "ts")
    f = P.predict(P.model(s, ["channel"], "2024-01-30"), ["channel"], "2024-01-30", 30)
    holes = f.withColumn("yhat", F.when(F.day("ds") % 3 == 0, F.col("yhat")))
    known = s.where(F.dayofweek("ds") != 4)
    j = P.fallback(holes, known, ["channel"], "2024-01-30")
    # the mean is taken over all days of the window
    mean = P.recent(s, ["channel"], "2024-01-30").groupBy("channel").agg(F.avg("y").alias("mean"))
    j = j.join(mean, "channel").withColumn("yhat", F.when(F.col("origin") == "mean", F.col("mean")).otherwise(F.col("yhat")))
    return j.select("channel", day_text("ds").alias("ds"), r6("yhat").alias("yhat"), "origin")


@query("fc_range_check", f"""with {model_sql(LOAD, LOAD_AS_OF, 30)}, q as (select quantile_cont(y, 0.01) as lo, quantile_cont(y, 0.99) as hi from s0 where ds <= date '{LOAD_AS_OF}')
    select strftime(ds, '%Y-%m-%d') as ds, round(yhat, 6) as yhat, yhat between lo and hi as plausible from fc, q""")
def fc_range_check(t):
    from voltlake.functions.quantiles import percentiles
    from voltlake.operators.reports import side_by_side

    known = load_series(t).where(F.col("ds") <= F.lit(LOAD_AS_OF).cast("date"))
    j = side_by_side(load_forecast(t), percentiles(known, [], "y", {"lo": 0.01, "hi": 0.99}))
    return j.select(day_text("ds").alias("ds"), r6("yhat").alias("yhat"), F.col("yhat").between(F.col("lo"), F.col("hi")).alias("plausible"))


@query("fc_calibration", f"""with {BT} select level, round(avg(case when abs(yhat - y) <= z * sd then 1e0 else 0e0 end), 6) as coverage, count(*) as n
    from bt, (values (0.5e0, 0.674490e0), (0.8e0, 1.281552e0), (0.9e0, 1.644854e0), (0.95e0, 1.959964e0)) l(level, z) group by 1""")
def fc_calibration(t):
    return P.calibration(load_backtest(t))


@query("fc_channel_effect", """select user_id % 4 as channel, cast(count(*) filter (where event_type = 'view') as bigint) as views,
    cast(count(*) filter (where event_type = 'click') as bigint) as clicks, cast(count(*) filter (where event_type = 'signup') as bigint) as signups,
    cast(count(*) filter (where event_type = 'purchase') as bigint) as purchases,
    round(count(*) filter (where event_type = 'signup') / cast(count(*) filter (where event_type = 'view') as double), 6) as conversion,
    round(cast(sum(case when event_type = 'click' then cast(value as decimal(18,2)) end) as double) / count(*) filter (where event_type = 'signup'), 6) as spend_per_signup
    from events group by 1""")
def fc_channel_effect(t):
    return P.funnel(t.events, F.col("user_id") % 4, "event_type", "value")


Z_SQL = """m as (select user_id, median(value) as med from events group by 1),
    a as (select e.user_id, median(abs(value - med)) as mad from events e join m on m.user_id = e.user_id group by 1),
    z as (select e.event_id, e.user_id, e.value, case when mad > 0 then 0.6745e0 * (value - med) / mad end as z
          from events e join m on m.user_id = e.user_id join a on a.user_id = e.user_id)"""


@query("ano_usage", f"""with {Z_SQL} select event_id, user_id, value, round(1 - exp(-abs(z) / 3e0), 6) as anomaly_score,
    case when z > 0 then 'spike' else 'drop' end as type from z where abs(z) > 3.5""")
def ano_usage(t):
    return N.usage_anomalies(t.events.select("event_id", "user_id", "value"), ["user_id"], "value")


@query("ano_fraud", """with l as (select o_custkey, l_discount >= 0.10 as a, l_quantity >= 50 as b, l_returnflag = 'R' as c from lineitem join orders on l_orderkey = o_orderkey),
    s as (select *, (a::int + b::int + c::int) / 3e0 as s from l), g as (select o_custkey, max(s) as s, count(*) as cases, bool_or(a) as a, bool_or(b) as b, bool_or(c) as c
      from s where s > 0.5 group by 1)
    select o_custkey as account_id, round(s, 6) as fraud_score, cases, concat_ws(',', case when a then 'high_discount' end, case when b then 'bulk_quantity' end,
      case when c then 'returned' end) as indicators from g""")
def ano_fraud(t):
    l = t.lineitem.select("l_orderkey", "l_discount", "l_quantity", "l_returnflag").join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return N.fraud_cases(l, "o_custkey", 0.5).withColumn("indicators", F.array_join("indicators", ","))


@query("ano_threshold_tune", """with g as (select score, sum(label) as p, sum(1 - label) as n from fx_churn group by 1),
    w as (select score, sum(p) over (order by score desc) as cp, sum(n) over (order by score desc) as cn, sum(p) over () as ap, sum(n) over () as an from g),
    x as (select round(score, 6) as threshold, round(cp / cast(cp + cn as double), 6) as precision, round(cp / cast(ap as double), 6) as recall,
      round(cn / cast(an as double), 6) as false_positive_rate, round(2e0 * cp / (cp + cn + ap), 6) as f1 from w)
    select *, precision >= 0.7 and recall >= 0.85 and false_positive_rate <= 0.05 as feasible from x order by feasible desc, f1 desc, threshold desc limit 1""")
def ano_threshold_tune(t):
    return N.tune_threshold(t.fx_churn, "score", "label")


@query("seg_customers", f"""select c_custkey, spend, cast(ntile(3) over (order by spend, c_custkey) as int) as tier from ({SPEND_SQL}) s""")
def seg_customers(t):
    return C.value_tiers(customer_spend(t).select("c_custkey", "spend"), "spend", "c_custkey")


@query("seg_kmeans")
def seg_kmeans(t):
    out, _ = C.kmeans(t.embeddings, "embedding", 10)
    return out.groupBy(F.col("prediction").alias("segment")).agg(F.count("*").alias("size"))


@query("seg_silhouette")
def seg_silhouette(t):
    rows = [(name, float(C.kmeans(t.embeddings, "embedding", 10, bisecting=b)[1])) for name, b in (("kmeans", False), ("bisecting", True))]
    return t.spark.createDataFrame(rows, "method string, silhouette double").withColumn("passed", F.col("silhouette") >= 0.5)


def half(t, early):
    cut = F.lit("1998-06-30").cast("timestamp_ntz")
    o = t.orders.where(F.col("o_orderdate") <= cut if early else F.col("o_orderdate") > cut)
    s = o.groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("s"))
    return C.value_tiers(s.select("o_custkey", F.col("s").cast("double").alias("spend")), "spend", "o_custkey")


@query("seg_stability", """with s as (select o_custkey, o_orderdate <= timestamp '1998-06-30' as early, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as spend from orders group by 1, 2),
    k as (select *, cast(ntile(3) over (partition by early order by spend, o_custkey) as int) as tier from s),
    m as (select a.tier as before, b.tier as after, count(*) as n from k a join k b on a.o_custkey = b.o_custkey where a.early and not b.early group by 1, 2)
    select before, after, n, round(sum(case when before = after then n else 0 end) over () / cast(sum(n) over () as double), 6) as agreement,
      sum(case when before = after then n else 0 end) over () / cast(sum(n) over () as double) >= 0.8 as stable from m""")
def seg_stability(t):
    return C.tier_overlap(half(t, True), half(t, False), "o_custkey")


@query("clv_customer", f"select c_custkey, c_mktsegment, round({CLV}, 6) as clv from ({SPEND_SQL}) s")
def clv_customer(t):
    return C.lifetime_value(customer_spend(t)).select("c_custkey", "c_mktsegment", r6("clv").alias("clv"))


@query("clv_holdout", """with g as (select o_custkey, min(o_orderdate) filter (where o_orderdate < timestamp '2000-07-01') as f,
      sum(case when o_orderdate < timestamp '2000-07-01' then cast(o_totalprice as decimal(18,2)) end) as spend,
      sum(case when o_orderdate >= timestamp '2000-07-01' and datediff('day', timestamp '2000-07-01', o_orderdate) < 365 then cast(o_totalprice as decimal(18,2)) end) as actual
      from orders group by 1),
    p as (select cast(spend as double) / greatest(1e0, datediff('day', f, timestamp '2000-07-01') / 365.25e0) * (365 / 365.25e0) as predicted,
      coalesce(cast(actual as double), 0) as actual from g where spend is not null)
    select count(*) as customers, round(avg(case when actual <> 0 then abs(predicted - actual) / actual end), 6) as mape,
      avg(case when actual <> 0 then abs(predicted - actual) / actual end) <= 0.20 as passed from p""")
def clv_holdout(t):
    m = F.avg(F.when(F.col("actual") != 0, F.abs(F.col("predicted") - F.col("actual")) / F.col("actual")))
    return C.clv_holdout(t.orders, "2000-07-01").agg(F.count("*").alias("customers"), r6(m).alias("mape"), (m <= 0.20).alias("passed"))
