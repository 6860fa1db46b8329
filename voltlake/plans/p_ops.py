"""Cost, task log, operations and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltlake.functions.scalars import day_text, lookup, r6, ts_text
from voltlake.operators import conversations as V
from voltlake.operators import cost as C
from voltlake.operators import ops as O
from voltlake.plans.registry import query
from voltlake.session import scratch
from voltlake.tables import micros

# The names a policy knows, and the ceilings.
KNOWN_AGENTS = (
    "supervisor-director", "intake-triage", "data-cataloguer", "data-contracts-quality", "ingestion-orchestrator", "etl-transformer",
    "feature-store-manager", "experiment-planner", "churn-forecast-modeler", "acquisition-forecast-modeler", "load-consumption-forecast",
    "pricing-tariff-optimizer", "portfolio-risk-modeler", "trial-design-causal-inference", "anomaly-fraud-detector", "customer-segmentation-clv",
    "prompt-model-evaluator", "mlops-deployer", "monitoring-drift-watcher", "crosscloud-trainer", "viz-storyteller", "human-loop-coordinator",
    "compliance-privacy-auditor", "cost-optimizer", "knowledge-manager",
)
CEILINGS = {0: 8.0, 1: 10.0, 2: 12.0, 3: 15.0, 4: 20.0}
BUDGET = 14_000.0


@query("cost_record", """select cast(user_id % 5 as varchar) as agent_name, count(*) as n, cast(sum(cast(value as decimal(18,6))) as double) as cost_gbp from events group by 1""")
def cost_record(t):
    out = scratch(t.spark, "cost")
    rows = t.events.select((F.col("user_id") % 5).cast("string").alias("agent_name"), F.col("ts").alias("timestamp"), F.col("event_id").cast("string").alias("task_id"),
                           F.col("value").alias("cost_gbp"), F.col("event_type").alias("resource_type"), F.create_map(F.lit("props"), "props").alias("metadata"))
    C.record(rows, out)
    return t.spark.read.parquet(out).groupBy("agent_name").agg(F.count("*").alias("n"), F.sum("cost_gbp").cast("double").alias("cost_gbp"))


@query("cost_agent_spend", """select agent, cast(sum(cost_gbp) as double) as spend from fx_cost_log where ts between timestamp '2024-01-10' and timestamp '2024-01-20' group by 1""")
def cost_agent_spend(t):
    return C.agent_spend(t.fx_cost_log, "2024-01-10", "2024-01-20")


@query("cost_daily_spend", "select cast(ds as varchar) as ds, resource_type, cast(sum(cost_gbp) as double) as spend from fx_cost_log group by 1, 2")
def cost_daily_spend(t):
    return C.daily_spend(t.fx_cost_log, "resource_type").select(day_text("ds").alias("ds"), "resource_type", F.col("spend").cast("double").alias("spend"))


@query("cost_7d_by_agent", """select cast(ds as varchar) as ds, agent, cast(sum(cost_gbp) as double) as spend from fx_cost_log
    where ds > date '2024-01-30' - interval 7 day and ds <= date '2024-01-30' group by 1, 2""")
def cost_7d_by_agent(t):
    return C.last_days(t.fx_cost_log, "2024-01-30").select(day_text("ds").alias("ds"), "agent", F.col("spend").cast("double").alias("spend"))


@query("cost_breakdown", """with d as (select * from fx_cost_log where ds = date '2024-01-15'),
    g as (select 'agent' as kind, cast(agent as varchar) as name, sum(cost_gbp) as s from d group by 2 union all select 'resource_type', resource_type, sum(cost_gbp) from d group by 2
      union all select 'total', 'all', sum(cost_gbp) from d),
    r as (select *, row_number() over (partition by kind order by s desc, name) as k from g)
    select kind, case when k <= 3 then name else 'other' end as name, cast(sum(s) as double) as spend,
      round(cast((select sum(cost_gbp) from d) as double) / 20000, 6) as budget_utilization,
      case when cast((select sum(cost_gbp) from d) as double) / 20000 < 0.8 then 'ok' else 'warning' end as alert_level from r group by 1, 2""")
def cost_breakdown(t):
    return C.breakdown(t.fx_cost_log.where(F.col("ds") == F.lit("2024-01-15").cast("date")), 20_000.0)


@query("cost_forecast", """with d as (select cast(sum(cost_gbp) as double) as y, datediff('day', date '2024-01-01', ds) as x from fx_cost_log group by ds),
    a as (select avg(y) as m, stddev_samp(y) as sd, regr_slope(y, x) as s from d)
    select 30 as forecast_days, round(m * 30, 6) as projected_total, round(m * 30 - 1.96e0 * sd * sqrt(30e0), 6) as lo95, round(m * 30 + 1.96e0 * sd * sqrt(30e0), 6) as hi95,
      case when s / m > 0.01 then 'rising' when s / m < -0.01 then 'falling' else 'stable' end as trend from a""")
def cost_forecast(t):
    return C.forecast(t.fx_cost_log, "2024-01-01")


@query("cost_recommend", """with g as (select resource_type, cast(coalesce(sum(case when cost_gbp < 5 then cost_gbp end), 0) as double) as i,
      cast(coalesce(sum(case when cost_gbp > 100 then cost_gbp end), 0) as double) as b from fx_cost_log group by 1),
    r as (select resource_type as area, 'scale down idle runs' as recommendation, round(i * 0.5e0, 6) as potential_savings_gbp, 'medium' as priority from g
      union all select resource_type, 'right-size dear runs', round(b * 0.1e0, 6), 'high' from g)
    select *, round(sum(potential_savings_gbp) over (), 4) as total_potential_savings_gbp from r where potential_savings_gbp > 0""")
def cost_recommend(t):
    from pyspark.sql import Window as W

    r = C.recommendations(t.fx_cost_log, 5.0)
    return r.withColumn("total_potential_savings_gbp", F.round(F.sum("potential_savings_gbp").over(W.partitionBy()), 4))  # two rows per resource type


@query("cost_anomalous", """with d as (select agent, ds, cast(sum(cost_gbp) as double) as spend from fx_cost_log group by 1, 2), m as (select agent, median(spend) as med from d group by 1),
    a as (select d.agent, median(abs(spend - med)) as mad from d join m on m.agent = d.agent group by 1)
    select d.agent, cast(d.ds as varchar) as ds, spend, round(0.6745e0 * (spend - med) / mad, 6) as z from d join m on m.agent = d.agent join a on a.agent = d.agent
    where mad > 0 and abs(0.6745e0 * (spend - med) / mad) > 2.5""")
def cost_anomalous(t):
    return C.anomalous(t.fx_cost_log, 2.5).withColumn("ds", day_text("ds"))


RUN = "r as (select *, sum(cost_gbp) over (partition by ds order by ts, event_id rows unbounded preceding) as spent from fx_cost_log)"


@query("cost_budget_levels", f"""with {RUN}, l as (select *, case when cast(spent as double) / 14000 * 100 >= 100 then 'P1_halt' when cast(spent as double) / 14000 * 100 > 90 then 'P2_pause'
      when cast(spent as double) / 14000 * 100 > 80 then 'P3_warn' else 'ok' end as level from r)
    select cast(ds as varchar) as ds, level, arg_min(event_id, ts) as event_id, cast(min(spent) as double) as spent from l where level <> 'ok' group by 1, 2""")
def cost_budget_levels(t):
    return C.budget_levels(t.fx_cost_log, ["ts", "event_id"], BUDGET).withColumn("ds", day_text("ds"))


@query("cost_gate", f"""with {RUN}, s as (select event_id, cast(spent - cost_gbp as double) as spend, cast(cost_gbp as double) as est from r)
    select event_id, spend, est, case when spend >= 14000 then 'Daily budget exceeded' when est > 50 then concat('Task cost ceiling exceeded: £', printf('%.2f', est))
      when spend + est > 14000 then concat('Task would exceed daily budget: £', printf('%.2f', spend), ' + £', printf('%.2f', est), ' > £14000.00') else 'OK' end as reason from s""")
def cost_gate(t):
    r = C.running_spend(t.fx_cost_log, ["ts", "event_id"])
    s = r.select("event_id", (F.col("spent") - F.col("cost_gbp")).cast("double").alias("spend"), F.col("cost_gbp").cast("double").alias("est"))
    return s.withColumn("reason", C.gate(F.col("spend"), F.col("est"), BUDGET))


@query("cost_ceiling", """select event_id, agent, cast(cost_gbp as double) as cost_gbp, c.ceiling from fx_cost_log
    join (values (0, 8e0), (1, 10e0), (2, 12e0), (3, 15e0), (4, 20e0)) c(a, ceiling) on c.a = agent where cast(cost_gbp as double) > c.ceiling""")
def cost_ceiling(t):
    return C.over_ceiling(t.fx_cost_log, "agent", CEILINGS).select("event_id", "agent", F.col("cost_gbp").cast("double").alias("cost_gbp"), "ceiling")


@query("cost_attribution", """with e as (select user_id, sum(cast(value as decimal(18,2))) as s from events group by 1)
    select cast(sum(s) as double) as spend, cast(sum(case when c_acctbal > 0 then s end) as double) as attributed,
      round(cast(sum(case when c_acctbal > 0 then s end) as double) / cast(sum(s) as double), 6) as coverage,
      cast(sum(case when c_acctbal > 0 then s end) as double) / cast(sum(s) as double) >= 0.95 as met from e left join customer on c_custkey = user_id""")
def cost_attribution(t):
    log = t.events.select("user_id", F.col("value").cast("decimal(18,2)").alias("cost_gbp"))
    return C.attribution(log, t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id")), "user_id")


def pick(values, n=None):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (1 + F.col("user_id") % (n or len(values))).cast("int"))


INSTANCES = ["ml.m5.xlarge", "ml.p3.2xlarge", "ml.c5.large"]
INST_SQL = "(['ml.m5.xlarge', 'ml.p3.2xlarge', 'ml.c5.large'])[1 + user_id % 3]"
RATE_SQL = f"case {INST_SQL} when 'ml.p3.2xlarge' then 4.10e0 / 3600 else 0.28e0 / 3600 end"


@query("cost_estimate_batch", f"select event_id, {INST_SQL} as instance, round({RATE_SQL} * greatest(60e0, value * 100 / 1000 * 60), 6) as estimate from events")
def cost_estimate_batch(t):
    return t.events.select("event_id", pick(INSTANCES).alias("instance"), F.col("value")).select("event_id", "instance", r6(C.batch_estimate(F.col("value") * 100, F.col("instance"))).alias("estimate"))


@query("cost_estimate_train", f"select event_id, round({RATE_SQL} * value * 60, 6) as estimate from events")
def cost_estimate_train(t):
    return t.events.select("event_id", r6(C.train_estimate(pick(INSTANCES), F.col("value") * 60)).alias("estimate"))


@query("cost_estimate_etl", "select event_id, round(0.44e0 / 3600 * (2 + user_id % 8) * value * 60, 6) as estimate from events")
def cost_estimate_etl(t):
    return t.events.select("event_id", r6(C.etl_estimate(2 + F.col("user_id") % 8, F.col("value") * 60)).alias("estimate"))


@query("cost_instance_hours", """select event_id, backend, round(case backend when 'table' then case i when 'ml.m5.2xlarge' then 0.56e0 when 'ml.p3.2xlarge' then 4.10e0 when 'ml.p3.8xlarge' then 16.40e0
      else 0.28e0 end when 'flat' then 0.30e0 else 0.22e0 * 0.75e0 end * (value / 10) * (1 + event_id % 4), 6) as cost
    from (select *, (['table', 'flat', 'units'])[1 + user_id % 3] as backend, (['ml.m5.xlarge', 'ml.m5.2xlarge', 'ml.p3.2xlarge', 'ml.p3.8xlarge', 'ml.t3'])[1 + user_id % 5] as i from events) e""")
def cost_instance_hours(t):
    inst = pick(["ml.m5.xlarge", "ml.m5.2xlarge", "ml.p3.2xlarge", "ml.p3.8xlarge", "ml.t3"])
    e = t.events.select("event_id", pick(["table", "flat", "units"]).alias("backend"), inst.alias("i"), "value")
    return e.select("event_id", "backend", r6(C.job_cost(F.col("backend"), F.col("i"), F.col("value") / 10, 1 + F.col("event_id") % 4)).alias("cost"))


# task log ------------------------------------------------------------------------------------------------------------

PHRASES = ["Please reduce churn by 15%", "FORECAST demand for May", "optimize tariff levels", "Detect anomaly in usage", "predict customer acquisition",
           "segment customers again", "model risk of the book", "reduce churn", "tell me a story"]
PHRASE_SQL = f"concat(text, ' ', ({PHRASES!r})[1 + conv_id % 9])"


def request_texts(t):
    p = F.element_at(F.array(*[F.lit(x) for x in PHRASES]), (1 + F.col("conv_id") % 9).cast("int"))
    return t.conversations.where("role = 'user'").select("conv_id", "turn", F.concat("text", F.lit(" "), p).alias("request"))


@query("ops_triage", f"""with r as (select conv_id, turn, lower({PHRASE_SQL}) as t from conversations where role = 'user'),
    k as (select *, case when regexp_matches(t, 'reduce churn( by ([0-9]+)%)?') then 1 when regexp_matches(t, 'forecast (load|demand|consumption)') then 2
      when regexp_matches(t, 'optimize (pricing|tariff)') then 3 when regexp_matches(t, 'detect (fraud|anomaly)') then 4
      when regexp_matches(t, 'predict (customer )?acquisition') then 5 when regexp_matches(t, 'segment customers') then 6 when regexp_matches(t, 'model (portfolio )?risk') then 7 end as i from r)
    select conv_id, turn, (['daily_churn_pipeline', 'forecast_load', 'optimize_pricing', 'detect_fraud', 'train_acquisition', 'customer_segmentation', 'model_portfolio_risk'])[i] as task,
      (['churn_reduction', 'load_forecasting', 'pricing_optimization', 'fraud_detection', 'acquisition_forecasting', 'segmentation', 'risk_modeling'])[i] as goal_type,
      case when i = 1 then try_cast(regexp_extract(t, 'reduce churn( by ([0-9]+)%)?', 2) as int) end as target_value,
      case when i is null then 'clarification_needed' else 'accepted' end as state from k""")
def ops_triage(t):
    return O.triage(request_texts(t), "request").drop("request")


@query("ops_request_gate", """with a as (select *, count(*) over (partition by user_id order by ts range between interval 6 hour preceding and current row) as active from events)
    select event_id, case when event_type = 'view' then 'Missing business justification' when value > 50 then concat('Estimated cost ', cast(value as varchar), ' exceeds limit of £50')
      when active >= 5 then 'Maximum concurrent tasks (5) reached' else 'All validations passed' end as reason from a""")
def ops_request_gate(t):
    from voltlake.functions.ordered import trailing_total

    e = t.events.select("event_id", "user_id", micros("ts").alias("at"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("justification"), "value")
    active = trailing_total(e, ["user_id"], "at", {"active": F.lit(1)}, 6 * 3600, inclusive=True)
    return e.join(active, ["user_id", "at"]).select("event_id", O.request_gate(F.col("justification"), F.col("value"), F.col("active")).alias("reason"))


PRIORITY = {"1-URGENT": "critical", "2-HIGH": "high", "3-MEDIUM": "medium", "5-LOW": "low"}


@query("ops_deadline", """select o_orderkey, strftime(o_orderdate + to_hours(case left(o_orderpriority, 1) when '1' then 4 when '2' then 24 when '5' then 168 else 72 end),
    '%Y-%m-%d %H:%M:%S.%f') as deadline from orders""")
def ops_deadline(t):
    return t.orders.select("o_orderkey", ts_text(O.deadline(F.col("o_orderdate"), lookup(F.col("o_orderpriority"), PRIORITY))).alias("deadline"))


@query("ops_review_sla", """select o_orderkey, case when o_orderpriority = '2-HIGH' then 24 else 72 end as sla_hours,
    round(case when o_orderpriority = '2-HIGH' then 24 else 72 end - cast(o_orderkey % 100 as double), 6) as remaining_hours,
    case when o_orderpriority = '2-HIGH' then 24 else 72 end < o_orderkey % 100 as overdue, case when o_orderstatus = 'F' then 'proceed' else 'revise' end as next_action from orders""")
def ops_review_sla(t):
    now = F.col("o_orderdate") + F.make_dt_interval(hours=(F.col("o_orderkey") % 100).cast("int"))
    s = O.review_state(F.col("o_orderdate"), lookup(F.col("o_orderpriority"), PRIORITY), now, F.when(F.col("o_orderstatus") == "F", "approved").otherwise("rejected"))
    return t.orders.select("o_orderkey", *[c.alias(n) for n, c in s.items()])


@query("ops_review_latency", """select event_type as kind, round(quantile_cont(value / 10, 0.5), 6) as p50, round(quantile_cont(value / 10, 0.95), 6) as p95, quantile_cont(value / 10, 0.5) <= 4 as p50_met,
    quantile_cont(value / 10, 0.95) <= 24 as p95_met from events group by 1""")
def ops_review_latency(t):
    """Review hours of every kind of event."""
    from voltlake.functions.quantiles import percentiles

    h = t.events.select(F.col("event_type").alias("kind"), (F.col("value") / 10).alias("hours"))
    p = percentiles(h, ["kind"], "hours", {"p50": 0.5, "p95": 0.95})
    return p.select("kind", r6("p50").alias("p50"), r6("p95").alias("p95"), (F.col("p50") <= 4).alias("p50_met"), (F.col("p95") <= 24).alias("p95_met"))


ERRORS = ["DataQualityError", "SchemaMismatch", "OutOfMemoryError", "ReadTimeout", "ValidationError", "ModelNotFound", "DeploymentFailed", "BudgetExceeded",
          "SchemaEvolutionTimeout", "DataQualityTimeout", "Strange", "ResourceExhausted"]


@query("ops_error_freq", """select agent, user_id, epoch_us(ts) as "at", count(*) over w as n, count(*) over w >= 3 as recurring from fx_task_log where status = 'FAILED'
    window w as (partition by agent, user_id order by epoch_us(ts) range between 86399999999 preceding and current row)""")
def ops_error_freq(t):
    return O.error_frequency(t.fx_task_log.where("status = 'FAILED'"), ["agent", "user_id"], "ts")


@query("ops_error_classify", f"""with e as (select event_id, user_id % 5 as agent, ({ERRORS!r})[1 + event_id % 12] as name, ts from events where event_type = 'error'),
    f as (select *, count(*) over (partition by agent, name order by epoch_us(ts) range between 86399999999 preceding and current row) >= 3 as rec from e)
    select event_id, name, rec as recurring, case when name in ('DataQualityError', 'ValidationError', 'DataQualityTimeout') then case when rec then 'escalate' else 'fallback' end
      when name in ('OutOfMemoryError', 'ResourceExhausted') then 'scale_up' when name in ('ReadTimeout', 'SchemaEvolutionTimeout') then 'retry_with_backoff' when name = 'SchemaMismatch' then 'retry'
      when name = 'ModelNotFound' then 'fallback' when name = 'DeploymentFailed' then 'rollback' when name = 'BudgetExceeded' then 'skip' else 'diagnose' end as strategy from f""")
def ops_error_classify(t):
    names = F.element_at(F.array(*[F.lit(x) for x in ERRORS]), (1 + F.col("event_id") % 12).cast("int"))
    e = t.events.where("event_type = 'error'").select("event_id", (F.col("user_id") % 5).alias("agent"), names.alias("name"), "ts", micros("ts").alias("at"))
    f = O.error_frequency(e.drop("at"), ["agent", "name"], "ts")
    return e.join(f, ["agent", "name", "at"]).select("event_id", "name", "recurring", O.classify_error(F.col("name"), F.col("recurring"))[0].alias("strategy"))


RULES = [
    ("forecast", "data_missing", "use_previous_model", None, "P1", ["data-contracts-quality"]),
    ("forecast", "metrics_regress", "rollback_to_previous_model", "-0.05 AUC", "P2", ["mlops-deployer", "human-loop-coordinator"]),
    ("monitor", "data_drift_detected", "trigger_retrain", "PSI > 0.2", "P2", ["supervisor-director", "experiment-planner"]),
]


@query("ops_failure_rules", """select event_id, action, severity, recipient from (select event_id, user_id % 4 as m from events where event_type = 'error') e
    join (values (0, 'use_previous_model', 'P1', 'data-contracts-quality'), (1, 'rollback_to_previous_model', 'P2', 'mlops-deployer'),
      (1, 'rollback_to_previous_model', 'P2', 'human-loop-coordinator'), (2, 'trigger_retrain', 'P2', 'supervisor-director'), (2, 'trigger_retrain', 'P2', 'experiment-planner'))
      r(m, action, severity, recipient) on r.m = e.m""")
def ops_failure_rules(t):
    rules = t.spark.createDataFrame(RULES, "job string, mode string, action string, threshold string, severity string, notify array<string>")
    f = t.events.where("event_type = 'error'").select("event_id", pick(["forecast", "forecast", "monitor", "other"]).alias("job"),
                                                      pick(["data_missing", "metrics_regress", "data_drift_detected", "none"]).alias("mode"))
    return O.apply_failure_rules(f, rules, ["job", "mode"]).select("event_id", "action", "severity", "recipient")


@query("ops_exec_status", """select strftime(time_bucket(interval 5 minute, ts), '%Y-%m-%d %H:%M:%S.%f') as start, count(*) as executions,
    cast(count(*) filter (where status = 'COMPLETED') as bigint) as successes, cast(count(*) filter (where status = 'FAILED') as bigint) as failures from fx_task_log group by 1""")
def ops_exec_status(t):
    return O.windowed_status(t.fx_task_log, "ts", "status").withColumn("start", ts_text("start"))


@query("ops_service_metrics", """select strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S.%f') as start, count(distinct user_id) as active_conversations, cast(count(*) as double) as tasks_per_minute,
    round(cast(sum(cast(latency_ms as decimal(18,2))) as double) / 60000, 8) as utilisation, round(avg(case when status = 'FAILED' then 1e0 else 0e0 end), 6) as error_rate from fx_task_log group by 1""")
def ops_service_metrics(t):
    return O.service_metrics(t.fx_task_log, "ts").withColumn("start", ts_text("start"))


@query("ops_latency_pct", """select cast(epoch_us(ts) // 300000000 as bigint) as slot_no, round(quantile_cont(latency_ms, 0.5), 6) as p50, round(quantile_cont(latency_ms, 0.95), 6) as p95,
    round(quantile_cont(latency_ms, 0.99), 6) as p99 from fx_task_log group by 1""")
def ops_latency_pct(t):
    return O.latency_percentiles(t.fx_task_log, "ts", "latency_ms")


@query("ops_model_metrics", """with h as (select date_trunc('hour', ts) as hour, cast(sum(cast(value as decimal(18,2))) as double) / count(*) / 60 as auc, max(value) / 1000 as max_psi from events group by 1)
    select strftime(hour, '%Y-%m-%d %H:%M:%S.%f') as hour, round(auc, 6) as auc, round(max_psi, 6) as max_psi,
      coalesce(auc < 0.78 and lag(auc) over w < 0.78 and lag(hour) over w = hour - interval 1 hour, false) as alarm from h window w as (order by hour)""")
def ops_model_metrics(t):
    h = t.events.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(
        (F.sum(F.col("value").cast("decimal(18,2)")).cast("double") / F.count("*") / 60).alias("auc"), (F.max("value") / 1000).alias("max_psi"))
    a = O.model_alarm(h, "hour", "auc", 0.78)
    return a.select(ts_text("hour").alias("hour"), r6("auc").alias("auc"), r6("max_psi").alias("max_psi"), "alarm")


@query("ops_slo_window", """select agent, epoch_us(ts) as "at", round(avg(case when status = 'COMPLETED' then 1e0 else 0e0 end) over w, 6) as score,
    avg(case when status = 'COMPLETED' then 1e0 else 0e0 end) over w >= 0.8 as met from fx_task_log window w as (partition by agent order by ts range between interval 7 day preceding and current row)""")
def ops_slo_window(t):
    return O.slo(t.fx_task_log, ["agent"], "ts", F.col("status") == "COMPLETED", 7 * 86400, 0.8)


@query("ops_ready_by", """with d as (select o_orderdate as ds, o_orderdate + to_minutes(cast(120 + (count(*) * 31) % 180 as bigint)) as ready from orders group by 1),
    b as (select *, make_date(year(ds), 3, 31) - cast(dayofweek(make_date(year(ds), 3, 31)) as int) as s, case when year(ds) = 1995 then date '1995-10-22' else make_date(year(ds), 10, 31) - cast(dayofweek(make_date(year(ds), 10, 31)) as int) end as e from d)
    select strftime(ds, '%Y-%m-%d') as ds, ready + case when ready >= s + interval 1 hour and ready < e + interval 1 hour then interval 1 hour else interval 0 hour end <= ds + interval 4 hour as on_time from b""")
def ops_ready_by(t):
    p = t.orders.groupBy(F.col("o_orderdate").alias("ds")).agg(F.count("*").alias("n"))
    p = p.select("ds", (F.col("ds") + F.make_dt_interval(mins=(120 + (F.col("n") * 31) % 180).cast("int"))).alias("ready"))
    return O.ready_by(p, "ds", "ready", "04:00:00").select(day_text("ds").alias("ds"), "on_time")


AGENTS = ["etl-transformer", "pricing-tariff-optimizer", "viz-storyteller", "unlisted"]


@query("ops_policy_gate", f"""with s as (select event_id, ({AGENTS!r})[1 + user_id % 4] as agent, value * 2 as cost, event_id % 5 as retries from events)
    select event_id, agent, case when cost > 150 then concat('Daily budget exceeded: £', printf('%.2f', cost)) when retries >= 3 then concat('Max retries exceeded: ', retries, '/3')
        when agent = 'pricing-tariff-optimizer' then concat(agent, ' requires human approval in production') else 'allowed' end as reason,
      case when cost + 5 > 150 then concat('Cost ceiling breach: ', printf('%.2f', cost + 5), ' > 150.0') when retries >= 3 then concat('Max retries exceeded: ', retries)
        when agent = 'unlisted' then 'Unknown agent: unlisted' else 'All policy checks passed' end as director_reason from s""")
def ops_policy_gate(t):
    s = t.events.select("event_id", pick(AGENTS).alias("agent"), (F.col("value") * 2).alias("cost"), (F.col("event_id") % 5).alias("retries"))
    a, c, r = F.col("agent"), F.col("cost"), F.col("retries")
    return s.select("event_id", "agent", O.policy_gate(a, c, r, F.lit(3), 150.0, True).alias("reason"), O.director_gate(a, sorted(KNOWN_AGENTS), c, r, F.lit(3)).alias("director_reason"))


# Declared targets of the contracts this library can measure.
TARGETS = [
    ("operations", "supervisor", "task_completion_rate", ">=", 0.95), ("operations", "supervisor", "policy_violation_rate", "==", 0.0),
    ("data", "ingestion", "ingestion_success_rate", ">=", 0.995), ("data", "ingestion", "duplicate_rate", "<=", 0.001),
    ("data", "catalogue", "catalog_coverage", ">=", 0.98), ("data", "catalogue", "lineage_completeness", ">=", 0.95),
    ("data", "quality", "contract_compliance_rate", ">=", 0.99), ("models", "churn", "validation_auc", ">=", 0.78),
    ("models", "churn", "calibration_error", "<=", 0.02), ("models", "load", "mape", "<=", 0.08),
    ("models", "evaluation", "hallucination_rate", "<=", 0.02), ("models", "evaluation", "eval_coverage", ">=", 0.95),
]


@query("ops_kpi_scorecard", """with m as (select 'task_completion_rate' as metric, avg(case when event_type <> 'error' then 1e0 else 0e0 end) as value from events
      union all select 'duplicate_rate', 1 - count(distinct (l_orderkey, l_linenumber)) / cast(count(*) as double) from lineitem
      union all select 'catalog_coverage', count(l.doc_id) / cast(count(*) as double) from documents d left join labels l on l.doc_id = d.doc_id
      union all select 'hallucination_rate', avg(toxic) from labels
      union all select 'contract_compliance_rate', avg(case when c_acctbal between -1000 and 10000 then 1e0 else 0e0 end) from customer),
    t(domain, job, metric, op, target) as (values ('operations', 'supervisor', 'task_completion_rate', '>=', 0.95e0), ('operations', 'supervisor', 'policy_violation_rate', '==', 0e0),
      ('data', 'ingestion', 'ingestion_success_rate', '>=', 0.995e0), ('data', 'ingestion', 'duplicate_rate', '<=', 0.001e0), ('data', 'catalogue', 'catalog_coverage', '>=', 0.98e0),
      ('data', 'catalogue', 'lineage_completeness', '>=', 0.95e0), ('data', 'quality', 'contract_compliance_rate', '>=', 0.99e0), ('models', 'churn', 'validation_auc', '>=', 0.78e0),
      ('models', 'churn', 'calibration_error', '<=', 0.02e0), ('models', 'load', 'mape', '<=', 0.08e0), ('models', 'evaluation', 'hallucination_rate', '<=', 0.02e0),
      ('models', 'evaluation', 'eval_coverage', '>=', 0.95e0)),
    j as (select t.*, coalesce(case op when '>=' then value >= target when '<=' then value <= target else value = target end, false) as passed from t left join m on m.metric = t.metric)
    select coalesce(domain, 'ALL') as domain, coalesce(job, 'ALL') as job, count(*) as metrics, round(avg(case when passed then 1e0 else 0e0 end), 6) as pass_rate from j group by rollup(domain, job)""")
def ops_kpi_scorecard(t):
    return O.pass_rates(scorecard(t))


def scorecard(t):
    from voltlake.functions.scalars import share
    from voltlake.operators.catalog import union_all
    from voltlake.operators.governance import coverage
    from voltlake.sources.files import duplicate_rate

    one = lambda name, df, c: df.select(F.lit(name).alias("metric"), F.col(c).cast("double").alias("value"))
    measured = union_all([
        one("task_completion_rate", t.events.agg(share(F.col("event_type") != "error").alias("v")), "v"),
        one("duplicate_rate", duplicate_rate(t.lineitem, ["l_orderkey", "l_linenumber"]), "duplicate_rate"),
        one("catalog_coverage", coverage(t.documents, t.labels, "doc_id"), "coverage"),
        one("hallucination_rate", t.labels.agg(F.avg("toxic").alias("v")), "v"),
        one("contract_compliance_rate", t.customer.agg(share(F.col("c_acctbal").between(-1000, 10000)).alias("v")), "v"),
    ])
    targets = t.spark.createDataFrame(TARGETS, "domain string, job string, metric string, op string, target double")
    return O.scorecard(targets, measured)


# conversations -------------------------------------------------------------------------------------------------------


@query("conv_summary", """select user_id * 100 + day(ts) as conv, user_id, count(*) as message_count, case when bool_or(event_type = 'purchase') then 'closed' else 'active' end as status,
    strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') as start_time, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') as end_time, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) as duration_seconds
    from events group by user_id, user_id * 100 + day(ts)""")
def conv_summary(t):
    e = t.events.withColumn("conv", F.col("user_id") * 100 + F.day("ts"))
    return V.summary(e, "conv", "user_id", "ts", F.col("event_type") == "purchase").withColumns({"start_time": ts_text("start_time"), "end_time": ts_text("end_time")})


@query("conv_roles", """select conv_id, count(*) as messages, cast(count(*) filter (where role = 'user') as bigint) as questions, max(turn) as last_turn from conversations group by 1""")
def conv_roles(t):
    return t.conversations.groupBy("conv_id").agg(F.count("*").alias("messages"), F.count_if(F.col("role") == "user").alias("questions"), F.max("turn").alias("last_turn"))


@query("conv_by_user", "select user_id, day(ts) as conv, count(*) as message_count from events group by 1, 2")
def conv_by_user(t):
    return V.by_user(t.events.withColumn("conv", F.day("ts").cast("long")), "user_id", "conv")


@query("conv_context_merge", "select user_id, event_type, arg_max(value, event_id) as value from events group by 1, 2")
def conv_context_merge(t):
    return V.merge_context(t.events, "user_id", "event_type", "value", "event_id")


@query("conv_append", """with n as (select conv_id, turn + 1000 as turn, 'user' as role, text from conversations where turn = 0)
    select conv_id, turn, role, concat('msg-', row_number() over (partition by conv_id order by turn)) as message_id from (select conv_id, turn, role from conversations union all select conv_id, turn, role from n) x""")
def conv_append(t):
    return appended(t)[0].select("conv_id", "turn", "role", "message_id")


def appended(t):
    new = t.conversations.where("turn = 0").select("conv_id", (F.col("turn") + 1000).alias("turn"), F.lit("user").alias("role"), "text")
    lost = new.where(F.col("conv_id") % 10 == 0).withColumn("conv_id", F.col("conv_id") + 1_000_000)
    return V.append(t.conversations, new.unionByName(lost), t.conversations.select("conv_id").distinct(), "conv_id", "turn")


@query("conv_append_orphans", "select conv_id + 1000000 as conv_id, text from conversations where turn = 0 and conv_id % 10 = 0")
def conv_append_orphans(t):
    return appended(t)[1].select("conv_id", "text")

