"""Task log analytics: triage, gates, errors, service levels and scorecards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voltlake.functions.ordered import trailing_total
from voltlake.functions.quantiles import percentiles
from voltlake.functions.scalars import first_reason, lookup, r6
from voltlake.tables import micros

# Request patterns in order, with task and goal.
GOALS = (
    (r"reduce churn( by (\d+)%)?", "daily_churn_pipeline", "churn_reduction"),
    (r"forecast (load|demand|consumption)", "forecast_load", "load_forecasting"),
    (r"optimize (pricing|tariff)", "optimize_pricing", "pricing_optimization"),
    (r"detect (fraud|anomaly)", "detect_fraud", "fraud_detection"),
    (r"predict (customer )?acquisition", "train_acquisition", "acquisition_forecasting"),
    (r"segment customers", "customer_segmentation", "segmentation"),
    (r"model (portfolio )?risk", "model_portfolio_risk", "risk_modeling"),
)
# Deadlines and review limits in hours, request limits, policy limits.
DEADLINE_HOURS = {"critical": 4, "high": 24, "medium": 72, "low": 168}
MAX_REQUEST_COST, MAX_ACTIVE = 50.0, 5
REVIEW_HOURS, REVIEW_HOURS_OTHER = {"high": 24}, 72
NEEDS_APPROVAL = ("pricing-tariff-optimizer", "portfolio-risk-modeler", "mlops-deployer")
# Error name parts in order, with strategy and confidence.
ERROR_RULES = (
    (("ResourceExhausted", "OutOfMemory"), "scale_up", 0.95),
    (("Timeout",), "retry_with_backoff", 0.90),
    (("SchemaEvolution", "SchemaM"), "retry", 0.75),
    (("ModelNotFound",), "fallback", 0.85),
    (("DeploymentFailed",), "rollback", 0.98),
    (("BudgetExceeded", "CostCeiling"), "skip", 1.0),
)
DATA_QUALITY_ERRORS = ("DataQuality", "ValidationError")


def triage(df: DataFrame, text: str) -> DataFrame:
    """Task, goal and numeric target of each request by the first pattern found; without one, a clarification."""
    low = F.lower(text)
    task = goal = None
    for pat, t, g in GOALS:
        hit = low.rlike(pat)
        task = F.when(hit, t) if task is None else task.when(hit, t)
        goal = F.when(hit, g) if goal is None else goal.when(hit, g)
    target = F.when(task == "daily_churn_pipeline", F.expr(f"try_cast(nullif(regexp_extract(lower(`{text}`), '{GOALS[0][0]}', 2), '') as int)".replace("\\d", "[0-9]")))
    return df.select("*", task.alias("task"), goal.alias("goal_type"), target.alias("target_value"),
                     F.when(task.isNull(), "clarification_needed").otherwise("accepted").alias("state"))


def request_gate(justification: Column, cost: Column, active: Column) -> Column:
    return first_reason([
        (justification.isNull(), "Missing business justification"),
        (cost > MAX_REQUEST_COST, F.concat(F.lit("Estimated cost "), cost.cast("string"), F.lit(" exceeds limit of £50"))),
        (active >= MAX_ACTIVE, "Maximum concurrent tasks (5) reached"),
    ], "All validations passed")


def deadline(created: Column, priority: Column) -> Column:
    return created + F.make_dt_interval(hours=lookup(priority, DEADLINE_HOURS, DEADLINE_HOURS["medium"]))


def review_state(created: Column, priority: Column, now: Column, decision: Column) -> dict[str, Column]:
    sla = lookup(priority, REVIEW_HOURS, REVIEW_HOURS_OTHER)
    left = sla - (F.unix_micros(now.cast("timestamp")) - F.unix_micros(created.cast("timestamp"))) / F.lit(3.6e9)
    return {"sla_hours": sla, "remaining_hours": r6(left), "overdue": left < 0, "next_action": F.when(decision == "approved", "proceed").otherwise("revise")}


def error_frequency(errors: DataFrame, keys: list[str], ts: str, hours: int = 24, threshold: int = 3) -> DataFrame:
    """Errors of the same kind in the trailing span, whose oldest instant is excluded, at each error."""
    pts = errors.select(*keys, micros(ts).alias("at"))
    t = trailing_total(pts, keys, "at", {"n": F.lit(1)}, hours * 3600)
    return t.withColumn("recurring", F.col("n") >= threshold)


def _has(name: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [name.contains(p) for p in parts])


def classify_error(name: Column, recurring: Column) -> tuple[Column, Column]:
    """Recovery strategy and its confidence; the order of the rules decides names that fit several."""
    dq = _has(name, DATA_QUALITY_ERRORS)
    strategy = F.when(dq & recurring, "escalate").when(dq, "fallback")
    confidence = F.when(dq & recurring, 1.0).when(dq, 0.80)
    for parts, s, c in ERROR_RULES:
        strategy = strategy.when(_has(name, parts), s)
        confidence = confidence.when(_has(name, parts), c)
    return strategy.otherwise("diagnose"), confidence.otherwise(F.lit(None).cast("double"))


def apply_failure_rules(failures: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """Declared action, severity and one row per recipient for each failure. The rules table is a fixed list."""
    return failures.join(F.broadcast(rules), keys).withColumn("recipient", F.explode("notify")).drop("notify")


def windowed_status(log: DataFrame, ts: str, status: str, minutes: int = 5) -> DataFrame:
    """Executions, successes and failures per window."""
    start = F.timestamp_micros(F.floor(micros(ts) / F.lit(minutes * 60_000_000)).cast("long") * F.lit(minutes * 60_000_000)).cast("timestamp_ntz")
    return log.groupBy(start.alias("start")).agg(
        F.count("*").alias("executions"), F.count_if(F.col(status) == "COMPLETED").alias("successes"), F.count_if(F.col(status) == "FAILED").alias("failures"))


def service_metrics(log: DataFrame, ts: str, minutes: int = 1) -> DataFrame:
    """Active users, tasks and error rate per window. Users are counted exactly in two steps, so no task holds a set."""
    start = F.date_trunc("minute", ts)
    per_user = log.groupBy(start.alias("start"), "user_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "FAILED").alias("f"), F.sum(F.col("latency_ms").cast("decimal(18,2)")).alias("busy"))
    return per_user.groupBy("start").agg(
        F.count("*").alias("active_conversations"), r6(F.sum("n") / F.lit(float(minutes))).alias("tasks_per_minute"),
        F.round(F.sum("busy").cast("double") / F.lit(60_000.0 * minutes), 8).alias("utilisation"), r6(F.sum("f") / F.sum("n")).alias("error_rate"))


def latency_percentiles(log: DataFrame, ts: str, value: str, seconds: int = 300) -> DataFrame:
    x = log.select(F.floor(micros(ts) / F.lit(seconds * 1_000_000)).cast("long").alias("slot_no"), value)
    p = percentiles(x, ["slot_no"], value, {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return p.select("slot_no", r6("p50").alias("p50"), r6("p95").alias("p95"), r6("p99").alias("p99"))


def model_alarm(hourly: DataFrame, at: str, value: str, limit: float, periods: int = 2) -> DataFrame:
    """Alarm when the value is below the limit in ``periods`` consecutive hours; a missing hour does not count.

    The input has one row per hour.
    """
    w = W.orderBy(at)
    bad = F.col(value) < limit
    run = bad
    for i in range(1, periods):
        ok = (F.lag(value, i).over(w) < limit) & (F.lag(at, i).over(w) == F.col(at) - F.expr(f"interval '{i}' hour"))
        run = run & F.coalesce(ok, F.lit(False))
    return hourly.withColumn("alarm", F.coalesce(run, F.lit(False)))


def slo(log: DataFrame, keys: list[str], ts: str, ok: Column, seconds: int, target: float) -> DataFrame:
    from voltlake.operators.quality import score_window

    return score_window(log, keys, ts, ok, seconds, target)


def ready_by(partitions: DataFrame, ds: str, ready: str, local_time: str, zone: str = "Europe/London") -> DataFrame:
    """Whether each day's partition was ready by a local time, and the share of days that were."""
    local = F.from_utc_timestamp(F.col(ready).cast("timestamp"), zone)
    due = F.to_timestamp(F.concat(F.date_format(ds, "yyyy-MM-dd"), F.lit(" " + local_time)))
    return partitions.withColumn("on_time", local <= due)


def policy_gate(agent: Column, cost: Column, retries: Column, max_retries: Column, budget: float, production: bool) -> Column:
    return first_reason([
        (cost > budget, F.format_string("Daily budget exceeded: £%.2f", cost)),
        (retries >= max_retries, F.format_string("Max retries exceeded: %d/%d", retries, max_retries)),
        (agent.isin(*NEEDS_APPROVAL) & F.lit(production), F.concat(agent, F.lit(" requires human approval in production"))),
    ], "allowed")


def director_gate(agent: Column, known: list[str], cost: Column, retries: Column, max_retries: Column, estimate: float = 5.0, limit: float = 150.0) -> Column:
    """Variant with an estimate added to the spend and a check of the name."""
    return first_reason([
        (cost + estimate > limit, F.format_string("Cost ceiling breach: %.2f > %.1f", cost + estimate, F.lit(limit))),
        (retries >= max_retries, F.format_string("Max retries exceeded: %d", retries)),
        (~agent.isin(*known), F.concat(F.lit("Unknown agent: "), agent)),
    ], "All policy checks passed")


def scorecard(targets: DataFrame, measured: DataFrame) -> DataFrame:
    """Pass or fail per metric. Both sides hold one row per declared metric."""
    j = targets.join(measured, "metric", "left")
    ok = F.when(F.col("op") == ">=", F.col("value") >= F.col("target")).when(F.col("op") == "<=", F.col("value") <= F.col("target")).otherwise(F.col("value") == F.col("target"))
    return j.withColumn("passed", F.coalesce(ok, F.lit(False)))


def pass_rates(card: DataFrame) -> DataFrame:
    from voltlake.operators.aggregates import with_subtotals

    return with_subtotals(card, [["domain", "job"], ["domain"], []], ["domain", "job"], [F.count("*").alias("metrics"), r6(F.avg(F.col("passed").cast("double"))).alias("pass_rate")])
