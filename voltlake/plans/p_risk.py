"""Pricing, risk, experiments, evaluation and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltlake.functions.ordered import asof
from voltlake.functions.scalars import money, normal_cdf_sql, r6, ts_text
from voltlake.operators import experiments as X
from voltlake.operators import pricing as P
from voltlake.operators import retrieval as R
from voltlake.operators import risk as K
from voltlake.operators import vectors as V
from voltlake.plans.registry import query
from voltlake.session import scratch
from voltlake.tables import micros


def tariff_segments(t):
    """Mean list price and sold quantity per kind of part; quantities are summed per part before the join."""
    sold = t.lineitem.groupBy("l_partkey").agg(F.sum(money("l_quantity")).alias("q"))
    return t.part.select("p_partkey", F.col("p_type").alias("segment"), "p_retailprice").join(sold, F.col("p_partkey") == F.col("l_partkey"), "left").groupBy("segment").agg(
        F.avg("p_retailprice").alias("p0"), F.sum("q").cast("double").alias("q0"))


CAND = """s as (select p_type as segment, avg(p_retailprice) as p0, cast(sum(q) as double) as q0 from part
      left join (select l_partkey, sum(cast(l_quantity as decimal(18,2))) as q from lineitem group by 1) l on l_partkey = p_partkey group by 1),
    c as (select segment, p0, q0, f as factor, p0 * f as price, q0 * pow(f, -1.5) as demand, (p0 * f - p0 * 0.7e0) * q0 * pow(f, -1.5) as margin,
        p0 * f * q0 * pow(f, -1.5) as revenue, p0 * (1 - 0.7e0) * q0 as margin0
      from s, (select unnest([0.8e0, 0.85e0, 0.9e0, 0.95e0, 1e0, 1.05e0, 1.1e0, 1.15e0, 1.2e0]) as f) g)"""


@query("price_optimise", f"""with {CAND}, r as (select *, 'maximize_margin' as strategy, row_number() over (partition by segment order by margin desc, factor) as k from c
      union all select *, 'maximize_retention', row_number() over (partition by segment order by demand desc, factor) from c where margin >= margin0 * (1 - 1e-12))
    select segment, strategy, round(price, 4) as unit_rate, round(p0 * 0.05e0, 4) as standing_charge, round(margin / margin0 - 1, 6) as margin_impact,
      round(demand / q0 - 1, 6) as demand_impact, factor from r where k = 1""")
def price_optimise(t):
    c = P.candidates(tariff_segments(t))
    return P.best(c, "maximize_margin").unionByName(P.best(c, "maximize_retention"))


@query("price_optimise_bounded")
def price_optimise_bounded(t):
    """Rates of largest margin while all segments together lose at most a twentieth of today's demand; held to exhaustive search by a test."""
    chosen, report = P.best_within(P.candidates(tariff_segments(t)), 0.05)
    return chosen.select("segment", "factor", F.round("margin", 2).alias("margin"), F.round("lost", 4).alias("lost"), F.lit(report["feasible"]).alias("feasible"), F.lit(report["gap"] / max(report["margin"], 1e-9)).alias("relative_gap"))


@query("price_sensitivity", f"""with {CAND} select segment, factor, round(margin, 2) as margin, round((margin - lag(margin) over w) / (factor - lag(factor) over w), 2) as slope
    from c window w as (partition by segment order by factor)""")
def price_sensitivity(t):
    return P.sensitivity(P.candidates(tariff_segments(t)))


@query("price_relax", f"""with {CAND}, v as (select *, greatest(0e0, 1.3e0 - margin / margin0) + greatest(0e0, 0.95e0 - demand / q0) as violation from c),
    r as (select *, row_number() over (partition by segment order by (violation <= 1e-9) desc, round(violation, 9), margin desc, factor) as k from v)
    select segment, violation <= 1e-9 as feasible, round(violation, 6) as violation, factor from r where k = 1""")
def price_relax(t):
    return P.relaxed(P.candidates(tariff_segments(t)), 0.3, 0.95)


@query("price_kpis", f"""with {CAND}, b as (select segment, arg_max(revenue, margin) as new, max(p0 * q0) as now, avg(margin) as m, stddev_samp(margin) as sd from c group by 1)
    select round(sum(new) / sum(now) - 1, 6) as revenue_improvement, round(sum(m) / sum(sd), 6) as risk_adjusted_return,
      sum(new) / sum(now) - 1 >= 0.02 as revenue_ok, sum(m) / sum(sd) >= 1.5 as return_ok from b""")
def price_kpis(t):
    c = P.candidates(tariff_segments(t))
    return P.kpis(c, P.best(c, "maximize_margin"))


# risk ----------------------------------------------------------------------------------------------------------------


@query("risk_var", """with q as (select quantile_cont(pnl, 0.05) as q from fx_pnl)
    select round(-max(q), 6) as var_95, round(-avg(case when pnl <= q then pnl end), 6) as expected_shortfall, round(stddev_samp(pnl), 6) as volatility,
      count(pnl) as days from fx_pnl, q""")
def risk_var(t):
    return K.value_at_risk(t.fx_pnl)


def positions(t):
    """Net exposure per brand: open lines long, filled lines short, at list price."""
    sign = F.when(F.col("l_linestatus") == "O", 1).otherwise(-1)
    net = t.lineitem.groupBy("l_partkey").agg(F.sum(money("l_quantity") * sign).alias("q"))
    return net.join(t.part.select("p_partkey", F.col("p_brand").alias("instrument"), "p_retailprice"), F.col("l_partkey") == F.col("p_partkey")).groupBy(
        "instrument").agg(F.sum(F.col("q") * money("p_retailprice")).cast("double").alias("exposure"))


POS = """pos as (select p_brand as instrument, cast(sum(cast(l_quantity as decimal(18,2)) * case when l_linestatus = 'O' then 1 else -1 end
      * cast(p_retailprice as decimal(18,2))) as double) as exposure from lineitem join part on l_partkey = p_partkey group by 1)"""


@query("risk_monte_carlo", f"""with {POS},
    h as (select exposure, path, md5('11:' || instrument || ':' || path) as h from pos, range(1, 10001) r(path)),
    u as (select exposure, path, (('0x' || substr(h, 1, 12))::bigint + 0.5e0) / 281474976710656e0 as a, (('0x' || substr(h, 13, 12))::bigint + 0.5e0) / 281474976710656e0 as b from h),
    p as (select path, cast(sum(cast(exposure * 0.02e0 * sqrt(-2e0 * ln(a)) * cos(2e0 * pi() * b) as decimal(24,4))) as double) as pnl from u group by 1),
    q as (select quantile_cont(pnl, 0.05) as q from p)
    select round(-max(q)) as var_95, round(-avg(case when pnl <= q then pnl end)) as expected_shortfall, round(stddev_samp(pnl)) as volatility, count(*) as paths from p, q""")
def risk_monte_carlo(t):
    out = K.monte_carlo(positions(t), "instrument", "exposure")
    return out.select(*[F.round(c).alias(c) for c in ("var_95", "expected_shortfall", "volatility")], "paths")


@query("risk_stress", f"""with {POS}, tt as (select sum(cast(exposure as decimal(28,4))) as total from pos)
    select scenario, round(cast(total as double) * (1 + f), 6) as value, round(cast(total as double) * f, 6) as pnl
    from tt, (values ('price_crash', -0.40e0), ('price_spike', 0.60e0), ('cold_snap', 0.25e0), ('mild_winter', -0.15e0), ('supply_outage', 0.35e0), ('demand_slump', -0.20e0)) s(scenario, f)""")
def risk_stress(t):
    return K.stress(positions(t).withColumn("exposure", F.col("exposure").cast("decimal(28,4)")), "exposure")


@query("risk_hedge", f"""with {POS} select instrument, leg, round(exposure * 0.8e0 * w, 6) as volume
    from pos, (values ('futures', 0.7e0), ('options', 0.3e0)) l(leg, w)""")
def risk_hedge(t):
    return K.hedges(positions(t), "instrument", "exposure")


@query("risk_backtest", """with x as (select pnl, quantile_cont(pnl, 0.05) over w as q, count(*) over w as c from fx_pnl where pnl is not null
      window w as (order by ds rows between 250 preceding and 1 preceding))
    select count(*) as days, cast(count(*) filter (where pnl < q) as bigint) as exceedances, round(1 - count(*) filter (where pnl < q) / cast(count(*) as double), 6) as var_accuracy,
      1 - count(*) filter (where pnl < q) / cast(count(*) as double) >= 0.95 as passed from x where c = 250""")
def risk_backtest(t):
    return K.backtest(t.fx_pnl, "ds", 250)


@query("risk_exposure_flag", f"with {POS} select instrument, exposure from pos where abs(exposure) > 500000")
def risk_exposure_flag(t):
    return K.large_exposures(positions(t), "exposure", 500_000)


@query("risk_stale_prices", """select q.event_id, p.value as price, epoch_us(q.ts) - epoch_us(p.ts) as age_us,
      case when (epoch_us(q.ts) - epoch_us(p.ts)) / 3.6e9 <= 1 then 'live' when (epoch_us(q.ts) - epoch_us(p.ts)) / 3.6e9 <= 4 then 'cached' else 'stale' end as state
    from (select * from events where event_type = 'purchase') q
    asof left join (select * from events where event_type = 'view') p on q.user_id % 25 = p.user_id % 25 and q.ts >= p.ts""")
def risk_stale_prices(t):
    e = t.events.select("event_id", (F.col("user_id") % 25).alias("instrument"), micros("ts").alias("at"), "value", "event_type")
    need = e.where("event_type = 'purchase'").select("event_id", "instrument", "at")
    ticks = e.where("event_type = 'view'").select("instrument", F.col("at").alias("tick_at"), F.col("value").alias("price"))
    j = asof(need, ticks, ["instrument"], "at", "tick_at", ["price"])
    age = (F.col("at") - F.col("tick_at")) / F.lit(3.6e9)
    return j.select("event_id", "price", (F.col("at") - F.col("tick_at")).alias("age_us"), K.price_state(age).alias("state"))


# experiments ---------------------------------------------------------------------------------------------------------

SAMPLE = "ceil(2 * p * (1 - p) * pow(1.959964e0 + 0.841621e0, 2) / pow(0.05e0, 2))"


@query("ab_design", f"""with g as (select arm, avg(converted) as p, count(*) as n, count(distinct ds) as d from fx_ab group by 1)
    select arm, round(p, 6) as baseline, cast({SAMPLE} as bigint) as sample_per_variant, cast(ceil({SAMPLE} * 2 / (n / cast(d as double))) as bigint) as duration_days from g""")
def ab_design(t):
    return X.design(t.fx_ab, "arm", "converted", "ds")


@query("ab_assign", "select c_custkey, (['control', 'treatment', 'holdback'])[1 + (c_custkey * 7919) % 3] as variant from customer")
def ab_assign(t):
    return t.customer.select("c_custkey", X.assign(F.col("c_custkey"), ["control", "treatment", "holdback"]).alias("variant"))


AB = """r as (select arm, count(*) as n, sum(converted) as x, avg(converted) as p from fx_ab group by 1),
    j as (select a.*, c.n as n0, c.x as x0, c.p as p0 from r a, (select * from r where arm = 0) c where a.arm <> 0),
    z as (select *, (p - p0) / sqrt(((x + x0) / cast(n + n0 as double)) * (1 - (x + x0) / cast(n + n0 as double)) * (1e0 / n + 1e0 / n0)) as z,
      sqrt(p * (1 - p) / n + p0 * (1 - p0) / n0) as se from j)"""


@query("ab_analyse", f"""with {AB}, q as (select *, 2 * (1 - {normal_cdf_sql('abs(z)')}) as pv from z)
    select arm, round(p0, 6) as control_rate, round(p, 6) as rate, round((p - p0) / p0, 6) as lift, round(z, 6) as z, round(pv, 6) as p_value,
      round(p - p0 - 1.959964e0 * se, 6) as ci_low, round(p - p0 + 1.959964e0 * se, 6) as ci_high,
      case when pv < 0.05 then case when p > p0 then cast(arm as varchar) else '0' end else 'none' end as winner from q""")
def ab_analyse(t):
    return X.analyse(t.fx_ab, "arm", "converted", 0)


@query("ab_power", f"""with {AB}, q as (select arm, {normal_cdf_sql('(abs(p - p0) / se - 1.959964e0)')} as pw from z) select arm, round(pw, 6) as power, pw >= 0.8 as enough from q""")
def ab_power(t):
    return X.power(t.fx_ab, "arm", "converted", 0)


def units(t):
    return t.fx_offline.select((F.col("user_id") % 3).alias("arm"), "user_id", "ds", "n_events", F.col("total").cast("double").alias("total"))


@query("ab_balance", """with l as (select user_id % 3 as arm, unnest(['n_events', 'total']) as covariate, unnest([cast(n_events as double), cast(total as double)]) as v from fx_offline),
    g as (select covariate, arm, avg(v) as m, var_samp(v) as s from l group by 1, 2)
    select a.covariate, a.arm, round((a.m - c.m) / sqrt((a.s + c.s) / 2), 6) as smd from g a join g c on a.covariate = c.covariate and c.arm = 0 where a.arm <> 0""")
def ab_balance(t):
    return X.balance(units(t), "arm", ["n_events", "total"], 0)


def treated_units(t):
    """User-days of all arms with their activity and outcome; every arm but the control is a treatment."""
    return t.fx_ab.join(t.fx_offline, ["user_id", "ds"]).select(
        (F.col("arm") != 0).cast("int").alias("treated"), "converted", F.least("n_events", F.lit(5)).alias("activity"), F.col("total").cast("double").alias("total"), F.dayofweek("ds").alias("dow"))


@query("ab_propensity", """with u as (select (a.arm <> 0)::int as t, converted as y, least(n_events, 5) as activity from fx_ab a join fx_offline o on a.user_id = o.user_id and a.ds = o.ds),
    g as (select activity, count(*) as n, sum(t) as nt, sum(t * y) as yt, sum((1 - t) * y) as yc from u group by 1 having sum(t) > 0 and sum(t) < count(*)),
    e as (select *, nt / cast(n as double) as e from g)
    select cast(sum(n) as bigint) as units, round(sum(yt / e) / sum(n), 6) as treated_rate, round(sum(yc / (1 - e)) / sum(n), 6) as control_rate,
      round((sum(yt / e) - sum(yc / (1 - e))) / sum(n), 6) as effect from e""")
def ab_propensity(t):
    return X.stratified_effect(treated_units(t), "activity", "treated", "converted")


@query("ab_propensity_model")
def ab_propensity_model(t):
    return X.propensity_effect(treated_units(t), ["activity", "total", "dow"], "treated", "converted")


@query("ab_uplift", """with r as (select c_mktsegment as segment, arm, count(*) as n, avg(converted) as p from fx_ab join customer on user_id = c_custkey group by 1, 2)
    select a.segment, a.arm, a.n, c.n as n0, round(a.p - c.p, 6) as uplift from r a join r c on a.segment = c.segment and c.arm = 0 where a.arm <> 0""")
def ab_uplift(t):
    u = t.fx_ab.join(t.customer.select("c_custkey", F.col("c_mktsegment").alias("segment")), F.col("user_id") == F.col("c_custkey"))
    return X.uplift(u, "segment", "arm", "converted", 0)


@query("canary_compare", """with s as (select case when (event_id * 7919) % 10 < 1 then 'c' else 'p' end as side, avg(case when event_type = 'error' then 1e0 else 0e0 end) as er,
      avg(value) as lat, avg(case when event_type = 'purchase' then 1e0 else 0e0 end) as acc, count(*) as n from events group by 1)
    select c.n as canary_n, round(c.er, 6) as canary_error_rate, round(c.lat, 6) as canary_latency, round(c.acc, 6) as canary_accuracy,
      p.n as production_n, round(p.er, 6) as production_error_rate, round(p.lat, 6) as production_latency, round(p.acc, 6) as production_accuracy,
      round(c.er / p.er - 1, 6) as error_rate_change, round(c.lat / p.lat - 1, 6) as latency_change, round(c.acc / p.acc - 1, 6) as accuracy_change,
      c.acc / p.acc - 1 < -0.05 as abort from (select * from s where side = 'c') c, (select * from s where side = 'p') p""")
def canary_compare(t):
    flag = lambda k: F.when(F.col("event_type") == k, 1.0).otherwise(0.0)
    c = X.canary(t.events, F.col("event_id"), 1, {"error_rate": flag("error"), "latency": F.col("value"), "accuracy": flag("purchase")})
    return c.withColumn("abort", F.col("accuracy_change") < -0.05)


# evaluation ----------------------------------------------------------------------------------------------------------


@query("eval_llm", """select lang, count(*) as n, round(avg(quality), 6) as accuracy, round(avg(toxic), 6) as hallucination_rate, round(avg(n_chars / 1000e0), 6) as avg_latency_s,
    round(sum(n_chars * 2 + 500) / 1e6 / (sum(n_chars) / 4e0 / 1000), 6) as cost_per_1k_tokens from documents d join labels l on d.doc_id = l.doc_id group by 1""")
def eval_llm(t):
    # quality and toxicity labels stand in for judged answers, four characters for a token
    j = t.documents.select("doc_id", "lang", "n_chars").join(t.labels, "doc_id")
    cost = F.sum(F.col("n_chars") * 2 + 500) / F.lit(1e6)
    return j.groupBy("lang").agg(F.count("*").alias("n"), r6(F.avg("quality")).alias("accuracy"), r6(F.avg("toxic")).alias("hallucination_rate"),
                                 r6(F.avg(F.col("n_chars") / 1000.0)).alias("avg_latency_s"), r6(cost / (F.sum("n_chars") / 4.0 / 1000)).alias("cost_per_1k_tokens"))


@query("eval_agent", """select agent, count(*) as tasks, round(avg(case when status = 'COMPLETED' then 1e0 else 0e0 end), 6) as success_rate, round(avg(latency_ms), 6) as avg_runtime,
    round(cast(sum(cast(latency_ms as decimal(18,2))) as double) * 0.01e0 / count(*), 6) as cost_per_task from fx_task_log group by 1""")
def eval_agent(t):
    from voltlake.functions.scalars import money_sum, share

    return t.fx_task_log.groupBy("agent").agg(
        F.count("*").alias("tasks"), r6(share(F.col("status") == "COMPLETED")).alias("success_rate"), r6(F.avg("latency_ms")).alias("avg_runtime"),
        r6(money_sum("latency_ms") * 0.01 / F.count("*")).alias("cost_per_task"))


@query("eval_relevance_latency", """with w as (select conv_id, turn, role, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) as w from conversations),
    p as (select u.conv_id, u.turn, case when a.conv_id is not null then len(list_intersect(u.w, a.w)) / cast(len(list_distinct(list_concat(u.w, a.w))) as double) end as j, a.conv_id is not null as answered
      from w u left join w a on a.conv_id = u.conv_id and a.turn = u.turn + 1 and a.role = 'assistant' where u.role = 'user'),
    l as (select quantile_cont(value, 0.95) as p95 from events)
    select count(*) as questions, round(avg(j), 6) as answer_relevance, round(avg(case when answered then 1e0 else 0e0 end), 6) as coverage, round(any_value(p95), 6) as latency_p95,
      coalesce(avg(j) >= 0.85 and avg(case when answered then 1e0 else 0e0 end) >= 0.95 and any_value(p95) <= 3000, false) as met from p, l""")
def eval_relevance_latency(t):
    from voltlake.functions.quantiles import percentiles
    from voltlake.functions.scalars import share
    from voltlake.operators.reports import side_by_side

    w = t.conversations.select("conv_id", "turn", "role", F.array_distinct(R.tokens(F.col("text"))).alias("w"))
    a = w.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("aw"))
    p = w.where("role = 'user'").join(a, ["conv_id", "turn"], "left")
    j = F.size(F.array_intersect("w", "aw")) / F.nullif(F.size(F.array_union("w", "aw")), F.lit(0))
    cover = share(F.col("aw").isNotNull())
    q = p.agg(F.count("*").alias("questions"), F.avg(F.when(F.col("aw").isNotNull(), j)).alias("r"), cover.alias("c"))
    o = side_by_side(q, percentiles(t.events, [], "value", {"p95": 0.95}))
    return o.select("questions", r6("r").alias("answer_relevance"), r6("c").alias("coverage"), r6("p95").alias("latency_p95"),
                    F.coalesce(F.expr("r >= 0.85 and c >= 0.95 and p95 <= 3000"), F.lit(False)).alias("met"))


# retrieval -----------------------------------------------------------------------------------------------------------


@query("kb_index", """with w as (select doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) as term from documents),
    tf as (select term, doc_id, count(*) as tf from w where term <> '' group by 1, 2)
    select term, doc_id, tf, df from tf join (select term, count(*) as df from tf group by 1) d using (term)""")
def kb_index(t):
    return R.index_rows(t.documents, "doc_id", "text", scratch(t.spark, "postings"))


SEARCH = "the über and leaux"


SEARCH_SQL = """with w as (select doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) as term from documents),
    tf as (select term, doc_id, count(*) as tf from w where term in ('the', 'über', 'and', 'leaux') group by 1, 2),
    d as (select term, ln(1 + (select count(*) from documents) / cast(count(*) as double)) as idf from tf group by 1)
    select doc_id, round(sum(tf * idf), 6) as score from tf join d using (term) group by 1 order by round(sum(tf * idf), 6) desc, doc_id limit 5"""


@query("kb_search", SEARCH_SQL)
def kb_search(t):
    return R.search(t.documents, "doc_id", "text", SEARCH)


@query("kb_search_vectors", """with q as (select embedding as q from embeddings where vec_id = 3),
    s as (select vec_id, round(list_sum(list_transform(list_zip(embedding, q), lambda p: cast(p[1] as double) * cast(p[2] as double))), 5) as score from embeddings, q)
    select vec_id, score from s order by score desc, vec_id limit 5""")
def kb_search_vectors(t):
    q = t.embeddings.where("vec_id = 3").first()["embedding"]  # the query vector
    return R.nearest(t.embeddings, "vec_id", "embedding", q)


@query("kb_search_postings", SEARCH_SQL)
def kb_search_postings(t):
    blocks, lexicon = R.write_postings(t.documents, "doc_id", "text", scratch(t.spark, "postings"))
    return R.search_postings(blocks, lexicon, SEARCH, t.documents.count()).withColumnRenamed("id", "doc_id")


def vector_index(t):
    centroids = V.fit_centroids(t.embeddings, "vec_id", "embedding")
    return V.write_index(t.embeddings, "vec_id", "embedding", centroids, scratch(t.spark, "vectors")), centroids


@query("kb_search_index")
def kb_search_index(t):
    """Every twentieth vector as a query against all, in as many of the nearest lists as a recall of 0.95 takes."""
    index, centroids = vector_index(t)
    q = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return V.search(q, "query_id", "embedding", index, centroids, probes=V.probes_for(t.embeddings, "vec_id", "embedding", centroids))


@query("kb_search_exact", """with s as (select q.vec_id as query_id, v.vec_id, round(list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda p: cast(p[1] as double) * cast(p[2] as double))), 5) as score
      from embeddings q, embeddings v where q.vec_id % 20 = 0)
    select query_id, vec_id, score, cast(rank as int) as rank from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 10""")
def kb_search_exact(t):
    index, centroids = vector_index(t)
    q = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return V.search(q, "query_id", "embedding", index, centroids, probes=None)


@query("kb_relevance", """with c as (select label as q, i, avg(cast(x as double)) as m from (select label, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings) group by 1, 2),
    e as (select vec_id, label, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings),
    s as (select c.q, e.vec_id, any_value(e.label) as label, sum(cast(e.x as double) * c.m) as s from e join c on e.i = c.i group by 1, 2),
    r as (select q, (label = q)::int as rel, row_number() over (partition by q order by s desc, vec_id) as r from s)
    select q as label, round(avg(rel), 6) as precision_at_k, round(sum(rel / log2(r + 1)) / (select sum(1 / log2(k + 1)) from range(1, 11) t(k)), 6) as ndcg_at_k
    from r where r <= 10 group by 1""")
def kb_relevance(t):
    return R.relevance(t.embeddings, "vec_id", "embedding", "label", 10)


@query("kb_learning", """select concat('agent-', user_id % 5) as agent, event_type as decision, case when value > 50 then 'good' else 'bad' end as outcome,
    concat('k=', json_extract_string(props, '$.k')) as lesson, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as recorded_at,
    sha256(concat_ws('|', concat('agent-', user_id % 5), event_type, case when value > 50 then 'good' else 'bad' end, strftime(ts, '%Y-%m-%d %H:%M:%S.%f'))) as entry_id
    from events""")
def kb_learning(t):
    return R.learning_entries(
        t.events, F.format_string("agent-%d", F.col("user_id") % 5), F.col("event_type"), F.when(F.col("value") > 50, "good").otherwise("bad"),
        F.concat(F.lit("k="), F.get_json_object("props", "$.k")), ts_text("ts"))


@query("kb_freshness", """with f as (select e.ts, i.event_id is not null as idx from events e left join (select event_id from events where ts < timestamp '2024-01-30') i using (event_id))
    select count(*) as documents, cast(count(*) filter (where idx) as bigint) as indexed, round(count(*) filter (where idx) / cast(count(*) as double), 6) as coverage,
      round((epoch_us(max(ts)) - epoch_us(max(ts) filter (where idx))) / 3.6e9, 6) as lag_hours,
      count(*) filter (where idx) / cast(count(*) as double) >= 0.95 and (epoch_us(max(ts)) - epoch_us(max(ts) filter (where idx))) / 3.6e9 <= 24 as met from f""")
def kb_freshness(t):
    return R.index_freshness(t.events, t.events.where(F.col("ts") < F.lit("2024-01-30").cast("timestamp_ntz")), "event_id", "ts")


@query("kb_gaps", """with s as (select list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')[1] as query from conversations where role = 'user'),
    w as (select doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) as term from documents),
    a as (select distinct term from (select term, doc_id, count(*) as tf from w group by 1, 2) x where tf >= 2)
    select query, count(*) as searches from s where query is not null and query not in (select term from a) group by 1""")
def kb_gaps(t):
    s = t.conversations.where("role = 'user'").select(F.get(R.tokens(F.col("text")), F.lit(0)).alias("query")).where(F.col("query").isNotNull())
    words = t.documents.select("doc_id", F.explode(R.tokens(F.col("text"))).alias("query")).groupBy("query", "doc_id").agg(F.count("*").alias("tf"))
    return R.gaps(s, "query", words.where("tf >= 2"))

