"""Data contracts and quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltlake.functions.scalars import share, ts_text
from voltlake.operators import joins as J
from voltlake.operators import quality as Q
from voltlake.plans.registry import query


def res(kind, column, bad, src, n="count(*)"):
    return f"select '{kind}' as expectation, '{column}' as \"column\", cast({n} as bigint) as evaluated, cast({bad} as bigint) as unexpected, {bad} = 0 as success from {src}"


@query("dq_not_null", res("not_null", "kind", "count(*) filter (where event_type = 'error')", "events"))
def dq_not_null(t):
    return Q.validate(t.events.select(F.nullif("event_type", F.lit("error")).alias("kind")), [Q.Expect("not_null", "kind")])


@query("dq_unique", """select l_orderkey, l_linenumber, count(*) as copies from lineitem group by 1, 2 having count(*) > 1""")
def dq_unique(t):
    return Q.duplicates(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("dq_between", res("between", "c_acctbal", "count(*) filter (where c_acctbal < 0 or c_acctbal > 9000)", "customer"))
def dq_between(t):
    return Q.validate(t.customer, [Q.Expect("between", "c_acctbal", 0, 9000)])


@query("dq_regex", res("regex", "c_name", "count(*) filter (where not regexp_matches(c_name, '^Customer#[0-9]{8}[1-9]$'))", "customer"))
def dq_regex(t):
    return Q.validate(t.customer, [Q.Expect("regex", "c_name", pattern="^Customer#[0-9]{8}[1-9]$")])


@query("dq_row_count", res("row_count", "*", "case when count(*) between 1 and 10000000 then 0 else 1 end", "lineitem"))
def dq_row_count(t):
    return Q.validate(t.lineitem, Q.suite_for("usage_feed", *Q.GENERIC_BOUNDS))


def customer_contract(t):
    return t.fx_customers.select(F.nullif(F.col("c_custkey"), F.lit(7)).alias("customer_id"), (15 + F.col("c_custkey") % 110).alias("age"), "email")


CC = "(select nullif(c_custkey, 7) as customer_id, 15 + c_custkey % 110 as age, email from fx_customers) c"
SUITE_SQL = " union all ".join([
    res("not_null", "customer_id", "count(*) filter (where customer_id is null)", CC),
    res("unique", "customer_id", "(count(customer_id) - count(distinct customer_id))", CC, "count(customer_id)"),
    res("between", "age", "count(*) filter (where age not between 18 and 120)", CC),
    res("regex", "email", "count(*) filter (where not regexp_matches(email, '^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-zA-Z0-9-.]+$'))", CC)])


@query("dq_suite_select", SUITE_SQL)
def dq_suite_select(t):
    return Q.validate(customer_contract(t), Q.suite_for("Customer_master"))


@query("dq_statistics", f"""select count(*) as evaluated_expectations, cast(count(*) filter (where success) as bigint) as successful_expectations,
    cast(count(*) filter (where not success) as bigint) as unsuccessful_expectations,
    round(100e0 * count(*) filter (where success) / count(*), 6) as success_percent, bool_and(success) as success,
    round(count(*) filter (where success) / cast(count(*) as double), 6) as compliance_rate from ({SUITE_SQL}) r""")
def dq_statistics(t):
    return Q.statistics(Q.validate(customer_contract(t), Q.suite_for("customer")))


@query("dq_violations", """select c_custkey, 'between' as expectation, 'age' as "column", cast(15 + c_custkey % 110 as varchar) as found
      from fx_customers where 15 + c_custkey % 110 not between 18 and 120
    union all select c_custkey, 'regex', 'email', email from fx_customers
      where not regexp_matches(email, '^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-zA-Z0-9-.]+$')""")
def dq_violations(t):
    df = t.fx_customers.select("c_custkey", (15 + F.col("c_custkey") % 110).alias("age"), "email")
    return Q.violations(df, "c_custkey", list(Q.CUSTOMER_SUITE[2:]))


@query("dq_block_downstream", """with g as (select source, avg(case when n_chars <= 15000 then 1e0 else 0e0 end) >= 0.99 as passed from documents group by 1)
    select source, lang, count(*) as n from documents where source in (select source from g where passed) group by 1, 2""")
def dq_block_downstream(t):
    ok = t.documents.groupBy("source").agg(share(F.col("n_chars") <= 15000).alias("s")).where("s >= 0.99")
    return J.gate(t.documents, ok, "source").groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("dq_score_window", """select agent, epoch_us(ts) as "at", round(avg(case when latency_ms between 1 and 200 then 1e0 else 0e0 end) over w, 6) as score,
      avg(case when latency_ms between 1 and 200 then 1e0 else 0e0 end) over w >= 0.99 as met
    from fx_task_log window w as (partition by agent order by ts range between interval 24 hour preceding and current row)""")
def dq_score_window(t):
    return Q.score_window(t.fx_task_log, ["agent"], "ts", F.col("latency_ms").between(1, 200), 86400, 0.99)


@query("dq_monitor_hourly", """select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S.%f') as hour,
    cast(count(*) filter (where status = 'COMPLETED') as bigint) as passed, cast(count(*) filter (where status = 'FAILED') as bigint) as failed
    from fx_task_log group by 1""")
def dq_monitor_hourly(t):
    return Q.hourly(t.fx_task_log, "ts", F.col("status") == "COMPLETED").withColumn("hour", ts_text("hour"))
