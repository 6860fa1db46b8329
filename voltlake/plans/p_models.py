"""Models, metrics, drift and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltlake.functions.scalars import r6
from voltlake.operators import drift as D
from voltlake.operators import metrics as M
from voltlake.operators import models as L
from voltlake.operators import reports as R
from voltlake.operators.aggregates import high_risk
from voltlake.plans.registry import query
from voltlake.session import scratch

FEATURES = ["n", "spend", "recency"]


def auc_sql(src, score="score", label="label", key=None):
    """AUC from mean ranks."""
    part = f"partition by {key}" if key else ""
    return f"""select {key + ',' if key else ''} round((sum(case when {label} = 1 then rk end) - sum({label}) * (sum({label}) + 1) / 2e0)
      / nullif(cast(sum({label}) as double) * (count(*) - sum({label})), 0), 6) as auc
      from (select *, rank() over ({part} order by {score}) + (count(*) over (partition by {(key + ',') if key else ''} {score}) - 1) / 2e0 as rk from {src}) q
      {'group by ' + key if key else ''}"""


def ece_sql(src, score="score", label="label", key=None):
    k = f"{key}, " if key else ""
    return f"""select {k} round(sum(n * abs(rate - ms)) / sum(n), 6) as calibration_error
      from (select {k} least(floor({score} * 10), 9) as b, count(*) as n, avg({label}) as rate, avg({score}) as ms from {src} group by {k} b) q
      {'group by ' + key if key else ''}"""


@query("ml_churn_label", "select custkey, n, cast(spend as double) as spend, cast(recency as int) as recency, label from fx_churn")
def ml_churn_label(t):
    return t.fx_churn.select("custkey", "n", F.col("spend").cast("double").alias("spend"), "recency", "label")


@query("ml_split", """select case when custkey % 10 <= 6 then 'train' when custkey % 10 <= 8 then 'validation' else 'holdout' end as split,
    count(*) as n, round(avg(label), 6) as label_rate, count(*) >= 300 as large_enough from fx_churn group by 1""")
def ml_split(t):
    return L.split_report(t.fx_churn.withColumn("split", L.split("custkey")), "split", "label", 300)


@query("ml_split_time", """select case when ts < timestamp '2024-01-21' then 'train' when ts < timestamp '2024-01-27' then 'validation' else 'holdout' end as split,
    count(*) as n, round(avg(case when event_type = 'error' then 1 else 0 end), 6) as label_rate, count(*) >= 10000 as large_enough from events group by 1""")
def ml_split_time(t):
    e = t.events.withColumn("split", L.split_by_time("ts", "2024-01-21", "2024-01-27")).withColumn("y", (F.col("event_type") == "error").cast("int"))
    return L.split_report(e, "split", "y")


@query("ml_leakage_check", """with p as (select count(*) as c from lineitem join orders on l_orderkey = o_orderkey where l_shipdate > o_orderdate),
    s as (select count(*) as c from (select user_id from events group by user_id
          having min(ts >= timestamp '2024-01-21') <> max(ts >= timestamp '2024-01-21')) x),
    n as (select (abs(corr(cast(value as double), value * 2 + 1)) > 0.99)::int + (abs(corr(cast(user_id as double), value * 2 + 1)) > 0.99)::int as c
          from events)
    select p.c as future_features, s.c as shared_keys, cast(n.c as bigint) as near_label, true as leak from p, s, n""")
def ml_leakage_check(t):
    pairs = t.lineitem.select("l_orderkey", "l_shipdate").join(t.orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    sp = t.events.select("user_id", "value", (F.col("value") * 2 + 1).alias("y"), L.split_by_time("ts", "2024-01-21", "2024-02-01").alias("split"))
    return L.leakage(pairs, "l_shipdate", "o_orderdate", sp, "user_id", ["value", "user_id"], "y")


@query("ml_churn_train")
def ml_churn_train(t):
    return L.train(t.fx_churn, FEATURES, "custkey")[1]


@query("ml_churn_predict")
def ml_churn_predict(t):
    from voltlake.sources.files import write_partitioned

    model, _ = L.train(t.fx_churn, FEATURES, "custkey", kind="gbt")
    out = scratch(t.spark, "predictions")
    scored = L.predict(model, t.fx_churn.select("custkey", "label", *[F.col(f).cast("double").alias(f) for f in FEATURES]))
    write_partitioned(scored.select("custkey", "label", "churn_score").withColumn("ds", F.lit("20001231")), out)
    return high_risk(t.spark.read.parquet(out), "churn_score", "label", 0.7)


COEF = {"n": -0.2, "spend": -0.000001, "recency": 0.004}


@query("ml_explain", """with m as (select avg(n) as mn, avg(cast(spend as double)) as ms, avg(recency) as mr from fx_churn),
    c as (select custkey, -0.2e0 * (n - mn) as n, -0.000001e0 * (cast(spend as double) - ms) as spend, 0.004e0 * (recency - mr) as recency from fx_churn, m)
    select custkey, round(n, 6) as n, round(spend, 6) as spend, round(recency, 6) as recency,
      case when abs(n) >= abs(spend) and abs(n) >= abs(recency) then 'n' when abs(spend) >= abs(recency) then 'spend' else 'recency' end as top_driver from c""")
def ml_explain(t):
    rows, _ = L.explain_linear(t.fx_churn, "custkey", COEF)
    return rows.select("custkey", *[r6(f).alias(f) for f in FEATURES], "top_driver")


@query("ml_explain_trees")
def ml_explain_trees(t):
    """Attributions of a boosted ensemble fitted on the training split, for every customer; tests hold them to the sums and to brute force."""
    from voltlake.operators.explain import explain_trees

    model, _ = L.train(t.fx_churn, FEATURES, "custkey", kind="gbt")
    rows = t.fx_churn.select("custkey", *[F.col(f).cast("double").alias(f) for f in FEATURES])
    return explain_trees(model, rows, "custkey", FEATURES)


@query("ml_importance", """with m as (select avg(n) as mn, avg(cast(spend as double)) as ms, avg(recency) as mr from fx_churn)
    select 'n' as feature, round(avg(abs(-0.2e0 * (n - mn))), 6) as importance from fx_churn, m
    union all select 'spend', round(avg(abs(-0.000001e0 * (cast(spend as double) - ms))), 6) from fx_churn, m
    union all select 'recency', round(avg(abs(0.004e0 * (recency - mr))), 6) from fx_churn, m""")
def ml_importance(t):
    return L.explain_linear(t.fx_churn, "custkey", COEF)[1].withColumn("importance", r6("importance"))


@query("ml_tune")
def ml_tune(t):
    return L.tune(t.fx_churn, FEATURES)


@query("ml_auc", auc_sql("fx_churn"))
def ml_auc(t):
    return M.auc(t.fx_churn, "score", "label")


@query("ml_confusion", """with c as (select cast(count(*) filter (where score >= 0.5 and label = 1) as bigint) as tp,
      cast(count(*) filter (where score >= 0.5 and label = 0) as bigint) as fp, cast(count(*) filter (where score < 0.5 and label = 1) as bigint) as fn,
      cast(count(*) filter (where score < 0.5 and label = 0) as bigint) as tn from fx_churn)
    select *, round(tp / cast(tp + fp as double), 6) as precision, round(tp / cast(tp + fn as double), 6) as recall,
      round(2e0 * tp / (2 * tp + fp + fn), 6) as f1, round(fp / cast(fp + tn as double), 6) as false_positive_rate from c""")
def ml_confusion(t):
    return M.confusion(t.fx_churn, "score", "label", 0.5)


@query("ml_calibration", """select b.*, e.calibration_error from (select cast(least(floor(score * 10), 9) as int) as bin, count(*) as n,
      round(avg(score), 6) as mean_score, round(avg(label), 6) as rate from fx_churn group by 1) b, (%s) e""" % ece_sql("fx_churn"))
def ml_calibration(t):
    bins = M.calibration_bins(t.fx_churn, "score", "label").select("bin", "n", r6("mean_score").alias("mean_score"), r6("rate").alias("rate"))
    return R.side_by_side(bins, M.ece(t.fx_churn, "score", "label"))


@query("ml_roc_points", """with g as (select score, sum(label) as p, sum(1 - label) as n from fx_churn group by 1)
    select round(score, 6) as threshold, round(sum(p) over w / cast(sum(p) over () as double), 6) as tpr,
      round(sum(n) over w / cast(sum(n) over () as double), 6) as fpr from g window w as (order by score desc)""")
def ml_roc_points(t):
    return M.roc_points(t.fx_churn, "score", "label")


def runs(t):
    """Five training runs: customers of one residue class each; the cost of a run is its spend share."""
    d = t.fx_churn.withColumn("run", (F.col("custkey") % 5).cast("string"))
    cost = d.groupBy("run").agg((F.sum("spend").cast("double") / 1e6).alias("cost"))
    return M.auc(d, "score", "label", ["run"]).join(cost, "run")


@query("ml_compare_runs", f"""with a as ({auc_sql("(select *, cast(custkey % 5 as varchar) as run from fx_churn)", key="run")}),
    r as (select a.run, a.auc, c.cost from a join (select cast(custkey % 5 as varchar) as run, cast(sum(spend) as double) / 1e6 as cost from fx_churn group by 1) c
          on a.run = c.run)
    select r.run, r.auc, round(r.cost, 6) as cost, round(r.auc - b.auc, 6) as auc_delta, round(r.cost - b.cost, 6) as cost_delta, b.auc - r.auc > 0.05 as regression,
      cast(row_number() over (order by r.auc desc, r.cost, r.run) as int) as rank_no from r, (select * from r where run = '0') b""")
def ml_compare_runs(t):
    return M.compare_runs(runs(t), "0").withColumn("cost", r6("cost"))


@query("ml_registry_pick", """with v as (select event_type || '-' || user_id % 7 as model, event_id, value, row_number() over (partition by event_type, user_id % 7 order by ts desc, event_id desc) as r
      from events),
    p as (select model, max(case when r = 1 then event_id end) as current, max(case when r = 2 then event_id end) as previous,
      max(case when r = 1 then value end) as m from v where r <= 2 group by 1)
    select model, current, previous, case when m >= 30 then current else coalesce(previous, current) end as serving from p""")
def ml_registry_pick(t):
    v = t.events.select(F.format_string("%s-%d", "event_type", F.col("user_id") % 7).alias("model"), "event_id", "value", "ts")
    return M.registry_pick(v, "model", ["ts", "event_id"], "event_id", "value", 30.0)


@query("ml_score_parity", """select count(*) as n, round(avg(case when abs(score - recency / (recency + 185e0)) <= 0.005 then 1e0 else 0e0 end), 6) as parity,
    avg(case when abs(score - recency / (recency + 185e0)) <= 0.005 then 1e0 else 0e0 end) >= 0.98 as passed from fx_churn""")
def ml_score_parity(t):
    other = t.fx_churn.select("custkey", (F.col("recency") / (F.col("recency") + 185.0)).alias("score"))
    return M.score_parity(t.fx_churn, other, "custkey", "score", 0.005)


# drift ---------------------------------------------------------------------------------------------------------------

DRIFT_FEATURES = ["value", "k", "hour", "user_id"]


def drift_input(t):
    return t.events.select(
        "ts", "user_id", "value", F.get_json_object("props", "$.k").cast("int").alias("k"), F.hour("ts").alias("hour"),
        (F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")).alias("is_current"))


LONG_SQL = """long as (select case when ts >= timestamp '2024-01-16' then 1 else 0 end as cur, unnest(['value', 'k', 'hour', 'user_id']) as feature,
      unnest([value, cast(json_extract_string(props, '$.k') as double), cast(hour(ts) as double), cast(user_id as double)]) as x from events)"""
PSI_SQL = f"""{LONG_SQL}, cuts as (select feature, unnest(quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) as c from long where cur = 0 group by 1),
    binned as (select l.feature, l.cur, (select count(*) from cuts k where k.feature = l.feature and k.c < l.x) as bin from long l),
    b as (select f.feature, n.bin, count(*) filter (where d.cur = 0) as r, count(*) filter (where d.cur = 1) as c
          from (select distinct feature from long) f cross join (select unnest(range(10)) as bin) n
          left join binned d on d.feature = f.feature and d.bin = n.bin group by 1, 2),
    s as (select feature, greatest(r / cast(sum(r) over (partition by feature) as double), 1e-6) as p,
            greatest(c / cast(sum(c) over (partition by feature) as double), 1e-6) as q from b),
    psi as (select feature, round(sum((q - p) * ln(q / p)), 6) as psi, sum((q - p) * ln(q / p)) > 0.2 as drift from s group by 1)"""
KS_SQL = f"""{LONG_SQL}, g as (select feature, x, sum(1 - cur) as r, sum(cur) as c from long group by 1, 2),
    w as (select feature, abs(sum(r) over (partition by feature order by x) / cast(sum(r) over (partition by feature) as double)
            - sum(c) over (partition by feature order by x) / cast(sum(c) over (partition by feature) as double)) as gap from g),
    n as (select feature, cast(sum(1 - cur) as double) as n, cast(sum(cur) as double) as m from long group by 1),
    d as (select w.feature, max(gap) as d, any_value(n.n) as n, any_value(n.m) as m from w join n on w.feature = n.feature group by 1),
    k as (select feature, d, d * sqrt(n * m / (n + m)) as lam from d)"""


@query("drift_psi", f"with {PSI_SQL} select * from psi")
def drift_psi(t):
    return D.psi(drift_input(t), DRIFT_FEATURES, F.col("is_current"))


@query("drift_ks", f"with {KS_SQL} select feature, round(d, 6) as ks, d > 0.3 as drift from k")
def drift_ks(t):
    return D.ks(drift_input(t), DRIFT_FEATURES, F.col("is_current")).drop("p_value")


@query("drift_significance", f"""with {KS_SQL} select feature, round(d, 6) as ks, round(least(1e0, greatest(0e0,
    2e0 * (exp(-2 * lam * lam) - exp(-8 * lam * lam) + exp(-18 * lam * lam) - exp(-32 * lam * lam) + exp(-50 * lam * lam)))), 6) as p_value from k""")
def drift_significance(t):
    return D.ks(drift_input(t), DRIFT_FEATURES, F.col("is_current")).drop("drift")


@query("drift_data_summary", f"""with {PSI_SQL} select bool_or(drift) as drift_detected, count(*) as features_analyzed,
    cast(count(*) filter (where drift) as bigint) as features_with_drift, coalesce(string_agg(case when drift then feature end, ',' order by feature), '') as drift_features,
    max(psi) as max_psi, round(avg(psi), 6) as mean_psi,
    case when count(*) filter (where drift) > 5 then 'high' when count(*) filter (where drift) > 0 then 'medium' else 'none' end as drift_severity from psi""")
def drift_data_summary(t):
    return D.data_summary(D.psi(drift_input(t), DRIFT_FEATURES, F.col("is_current")))


@query("topk_drift_features", f"with {PSI_SQL} select feature, psi from psi order by psi.psi desc, feature limit 10")
def topk_drift_features(t):
    return D.psi(drift_input(t), DRIFT_FEATURES, F.col("is_current")).select("feature", "psi").orderBy(F.desc("psi"), "feature").limit(10)


def periods(t):
    return t.fx_churn.withColumn("period", F.when(F.col("custkey") % 2 == 0, "baseline").otherwise("current"))


PERIODS = "(select *, case when custkey % 2 = 0 then 'baseline' else 'current' end as period from fx_churn)"
MODEL_DRIFT = f"""a as ({auc_sql(PERIODS, key="period")}), e as ({ece_sql(PERIODS, key="period")}),
    md as (select a0.auc as baseline_auc, e0.calibration_error as baseline_calibration_error, a1.auc as current_auc,
        e1.calibration_error as current_calibration_error, (a0.auc - a1.auc) / a0.auc * 100 as drop_pct
      from (select * from a where period = 'baseline') a0, (select * from a where period = 'current') a1,
        (select * from e where period = 'baseline') e0, (select * from e where period = 'current') e1)"""


@query("drift_model", f"""with {MODEL_DRIFT} select baseline_auc, baseline_calibration_error, current_auc, current_calibration_error,
    round(drop_pct, 6) as auc_drop_pct, drop_pct > 10 as drift_detected,
    case when drop_pct > 10 then 'high' when drop_pct > 5 then 'medium' else 'none' end as drift_severity from md""")
def drift_model(t):
    return model_drift(t)


def model_drift(t):
    p = periods(t)
    return D.model_drift(M.auc(p, "score", "label", ["period"]).join(M.ece(p, "score", "label", ["period"]), "period"))


def concept(t):
    daily = t.events.groupBy(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("d")).agg(F.avg(F.abs(F.col("value") - 50.0)).alias("r"))
    trend = daily.agg(D.residual_trend(daily, "d", "r").alias("trend"))
    halves = [R.importances(t.fx_churn.where(F.col("custkey") % 2 == i), FEATURES, "label") for i in (0, 1)]
    return R.side_by_side(trend, D.importance_shift(*halves))


CONCEPT_SQL = """dd as (select datediff('day', timestamp '2024-01-01', cast(ts as date)) as d, avg(abs(value - 50)) as r from events group by 1),
    tr as (select regr_slope(r, d) * count(*) / avg(r) as trend from dd),
    im as (select custkey % 2 as half, abs(corr(n, label)) as a, abs(corr(cast(spend as double), label)) as b, abs(corr(recency, label)) as c from fx_churn group by 1),
    nr as (select half, a / (a + b + c) as a, b / (a + b + c) as b, c / (a + b + c) as c from im),
    sh as (select 0.5e0 * (abs(x.a - y.a) + abs(x.b - y.b) + abs(x.c - y.c)) as shift from (select * from nr where half = 0) x, (select * from nr where half = 1) y)"""


@query("drift_concept", f"""with {CONCEPT_SQL} select round(trend, 6) as residual_trend, round(shift, 6) as feature_importance_shift,
    trend > 0.05 or shift > 0.10 as drift_detected, case when trend > 0.05 or shift > 0.10 then 'high' else 'none' end as drift_severity from tr, sh""")
def drift_concept(t):
    hit, sev = D.concept_verdict(F.col("trend"), F.col("shift"))
    return concept(t).select(r6("trend").alias("residual_trend"), r6("shift").alias("feature_importance_shift"), hit.alias("drift_detected"), sev.alias("drift_severity"))


@query("drift_action", """with s as (select (['none', 'medium', 'high'])[1 + user_id % 3] as data_severity, (['none', 'medium', 'high'])[1 + (user_id // 3) % 3] as model_severity,
      (user_id // 9) % 2 = 1 as concept_drift from events),
    a as (select *, case when data_severity = 'high' or model_severity = 'high' or concept_drift then case when concept_drift then 'emergency_retrain' else 'trigger_retrain' end
      when data_severity = 'medium' or model_severity = 'medium' then 'schedule_review' else 'monitor' end as action from s)
    select data_severity, model_severity, concept_drift, action, case action when 'emergency_retrain' then 'P1' when 'trigger_retrain' then 'P2' else 'P3' end as alert,
      count(*) as n from a group by all""")
def drift_action(t):
    sev = lambda i: F.element_at(F.array(F.lit("none"), F.lit("medium"), F.lit("high")), (1 + i % 3).cast("int"))
    u = F.col("user_id")
    s = t.events.select(sev(u).alias("data_severity"), sev(F.floor(u / 3)).alias("model_severity"), (F.floor(u / 9) % 2 == 1).alias("concept_drift"))
    sev_c = F.when(F.col("concept_drift"), "high").otherwise("none")
    act = D.action(F.col("data_severity"), F.col("model_severity"), sev_c, F.col("concept_drift"))
    return s.withColumn("action", act).withColumn("alert", D.alert(F.col("action"))).groupBy(
        "data_severity", "model_severity", "concept_drift", "action", "alert").agg(F.count("*").alias("n"))


@query("drift_recall", """with w as (select user_id, avg(value) > 50 as hit, user_id % 2 = 0 as truth from events group by user_id),
    c as (select cast(count(*) filter (where hit and truth) as bigint) as tp, cast(count(*) filter (where hit and not truth) as bigint) as fp,
      cast(count(*) filter (where not hit and truth) as bigint) as fn, cast(count(*) filter (where not hit and not truth) as bigint) as tn from w)
    select *, round(tp / cast(tp + fn as double), 6) as recall, round(fp / cast(fp + tn as double), 6) as false_positive_rate from c""")
def drift_recall(t):
    from voltlake.operators.privacy import detector_scores

    w = t.events.groupBy("user_id").agg((F.avg("value") > 50).alias("hit"))
    return detector_scores(w, F.col("hit"), F.col("user_id") % 2 == 0)


@query("drift_missing_baseline", """select distinct user_id as model from events e where ts >= timestamp '2024-01-16'
    and not exists (select 1 from events b where b.user_id = e.user_id and b.event_type = 'signup' and b.ts < timestamp '2024-01-08')""")
def drift_missing_baseline(t):
    from voltlake.operators.joins import missing

    at = lambda s: F.lit(s).cast("timestamp_ntz")
    now = t.events.where(F.col("ts") >= at("2024-01-16")).select(F.col("user_id").alias("model")).distinct()
    base = t.events.where((F.col("event_type") == "signup") & (F.col("ts") < at("2024-01-08"))).select(F.col("user_id").alias("model"))
    return missing(now, base, ["model"])


# reports -------------------------------------------------------------------------------------------------------------


def churn_facts(t):
    hr = high_risk(t.fx_churn, "score", "label", 0.7)
    top = R.top_driver(R.importances(t.fx_churn.withColumnRenamed("n", "number_of_orders"), ["number_of_orders", "spend", "recency"], "label"))
    return R.side_by_side(hr, M.auc(t.fx_churn, "score", "label"), M.ece(t.fx_churn, "score", "label"), top)


CHURN_FACTS = f"""f as (select count(*) as n, count(*) filter (where score >= 0.7) as h from fx_churn), a as ({auc_sql("fx_churn")}), e as ({ece_sql("fx_churn")}),
    i as (select 'Number Of Orders' as feature, abs(corr(n, label)) as w from fx_churn union all select 'Recency', abs(corr(recency, label)) from fx_churn
      union all select 'Spend', abs(corr(cast(spend as double), label)) from fx_churn)"""


@query("rep_churn", f"""with {CHURN_FACTS}
    select 0 as no, concat('🔴 ', printf('%.1f', 100e0 * h / n), '% of customers (', format('{{:,}}', h), ') are at high risk of churning') as insight from f
    union all select 1, concat('📊 Top churn driver: ', arg_max(feature, w), ' (', printf('%.0f', 100 * max(w)), '% importance)') from i
    union all select 2, case when auc >= 0.80 then concat('✅ Model performance is strong (AUC: ', printf('%.3f', auc), ')')
      else concat('⚠️ Model performance needs attention (AUC: ', printf('%.3f', auc), ')') end from a
    union all select 3, '💡 Recommended action: Proactive outreach to high-risk customers with retention offers'
    union all select 4, concat('Analyzed ', format('{{:,}}', n), ' customers with the daily churn forecast model. Identified ', format('{{:,}}', h),
      ' customers at high risk of churning in the next 30 days. Model performance: AUC ', printf('%.3f', auc), ', Calibration error ',
      printf('%.3f', calibration_error), '.') from f, a, e""")
def rep_churn(t):
    one = churn_facts(t)
    summary = one.select(F.lit(4).alias("no"), R.churn_summary("predictions_count", "high_risk_count", "auc", "calibration_error").alias("insight"))
    return R.churn_insights(one).unionByName(summary)


@query("rep_drift", f"""with {PSI_SQL}, {MODEL_DRIFT}, {CONCEPT_SQL}, v as (select (select count(*) from psi where drift) as nd, drop_pct,
      (select trend > 0.05 or shift > 0.10 from tr, sh) as cd from md)
    select 0 as no, concat('Data drift detected in ', nd, ' features') as insight from v
    union all select 1, concat('Model performance dropped by ', printf('%.1f', round(drop_pct, 6)), '%') from v
    union all select 2, concat('Recommended action: ', case when nd > 5 or drop_pct > 10 or cd then case when cd then 'emergency_retrain' else 'trigger_retrain' end
      when nd > 0 or drop_pct > 5 then 'schedule_review' else 'monitor' end) from v""")
def rep_drift(t):
    data = D.data_summary(D.psi(drift_input(t), DRIFT_FEATURES, F.col("is_current"))).select("features_with_drift", F.col("drift_severity").alias("ds"))
    model = model_drift(t).select("auc_drop_pct", F.col("drift_severity").alias("ms"))
    hit, sev = D.concept_verdict(F.col("trend"), F.col("shift"))
    one = R.side_by_side(data, model, concept(t))
    return R.drift_insights(one.withColumn("action", D.action(F.col("ds"), F.col("ms"), sev, hit)))


@query("rep_model_perf", f"""with a as ({auc_sql("fx_churn")}), e as ({ece_sql("fx_churn")}),
    c as (select 2e0 * count(*) filter (where score >= 0.5 and label = 1) / (count(*) filter (where score >= 0.5) + sum(label)) as f1 from fx_churn)
    select 0 as no, concat('AUC: ', printf('%.3f', auc)) as insight from a union all select 1, concat('Calibration error: ', printf('%.3f', calibration_error)) from e
    union all select 2, concat('F1 Score: ', printf('%.3f', f1)) from c""")
def rep_model_perf(t):
    return R.performance_insights(R.side_by_side(
        M.auc(t.fx_churn, "score", "label"), M.ece(t.fx_churn, "score", "label"), M.confusion(t.fx_churn, "score", "label", 0.5).select("f1")))


@query("rep_what_changed", """with k as (select strftime(o_orderdate, '%Y-%m') as period, concat('revenue_', o_orderstatus) as kpi,
      cast(sum(cast(o_totalprice as decimal(18,2))) as double) as value from orders group by 1, 2),
    d as (select *, value - lag(value) over (partition by kpi order by period) as delta from k)
    select period, kpi, value, round(delta, 6) as delta, cast(row_number() over (partition by period order by abs(round(delta, 6)) desc, kpi) as int) as rank_no
    from d where delta is not null""")
def rep_what_changed(t):
    from voltlake.functions.scalars import money_sum

    k = t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("period"), F.concat(F.lit("revenue_"), "o_orderstatus").alias("kpi")).agg(money_sum("o_totalprice").alias("value"))
    return R.what_changed(k, "period", "kpi", "value")


@query("rep_partial_flag", """select count(*) as expected_series, cast(count(*) filter (where p > 0) as bigint) as present_series, min(p) = 0 as partial
    from (select n_nationkey, count(user_id) as p from nation left join (select user_id, c_nationkey from events join customer on user_id = c_custkey) e on c_nationkey = n_nationkey group by 1) x""")
def rep_partial_flag(t):
    seen = t.events.join(t.customer, F.col("user_id") == F.col("c_custkey")).select(F.col("c_nationkey").alias("n_nationkey"))
    return R.partial_flag(t.nation.select("n_nationkey"), seen, ["n_nationkey"])


@query("rep_persist", f"""select insight, 0 as no, 'model_performance' as report_type, 20240131 as ds, 'run-1' as run_id
    from (select concat('AUC: ', printf('%.3f', auc)) as insight from ({auc_sql("fx_churn")}) a) x""")
def rep_persist(t):
    out = scratch(t.spark, "reports")
    one = R.side_by_side(M.auc(t.fx_churn, "score", "label")).select(F.lit(0).alias("no"), F.format_string("AUC: %.3f", "auc").alias("insight"))
    R.persist(one, out, "model_performance", "20240131", "run-1")
    return t.spark.read.json(out).select("insight", F.col("no").cast("int").alias("no"), "report_type", "ds", "run_id")
