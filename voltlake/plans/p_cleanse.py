"""Projections, filters, cleansing and row-level policy checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltlake.functions.scalars import day_text, money_sum, ts_text
from voltlake.operators import cleanse as C
from voltlake.operators import governance as G
from voltlake.plans.registry import query

SALT = "lake-salt:"


def bronze_feed(t):
    """One raw customer record per order, with dates in mixed formats; the newest order is the newest version."""
    odd = F.col("o_orderkey") % 3
    raw = (F.when(odd == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
           .when(odd == 1, F.date_format("o_orderdate", "dd/MM/yyyy"))
           .otherwise(F.date_format("o_orderdate", "yyyyMMdd")))
    o = t.orders.select("o_custkey", F.col("o_orderdate").alias("version"), F.col("o_orderkey").alias("seq"), raw.alias("last_seen"))
    return o.join(t.fx_customers, F.col("o_custkey") == F.col("c_custkey")).select(
        "c_custkey", "email", "c_mktsegment", "is_test", "version", "seq", "last_seen")


def silver(t):
    return C.bronze_to_silver(bronze_feed(t), "c_custkey", ["version", "seq"], "email", "last_seen", F.col("is_test"), SALT)


SILVER_SQL = f"""select c_custkey, c_mktsegment, o_orderdate as last_seen,
      sha256(concat('{SALT}', lower(trim(email)))) as email_hash
    from (select c.*, o.o_orderdate, row_number() over (partition by c.c_custkey order by o.o_orderdate desc, o.o_orderkey desc) as r
          from orders o join fx_customers c on o.o_custkey = c.c_custkey) x
    where r = 1 and not is_test and regexp_matches(email, '^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-zA-Z0-9-.]+$')"""


@query("etl_bronze_to_silver", f"""select c_custkey, c_mktsegment, strftime(last_seen, '%Y-%m-%d') as last_seen, email_hash
    from ({SILVER_SQL}) s""")
def etl_bronze_to_silver(t):
    return silver(t).select("c_custkey", "c_mktsegment", day_text("last_seen").alias("last_seen"), "email_hash")


@query("etl_bronze_to_silver_report", f"""select (select count(*) from orders) as records_in,
    (select count(*) from ({SILVER_SQL}) s) as records_out,
    'deduplicate,validate_email,hash_pii,standardize_dates,drop_test_accounts' as transformations""")
def etl_report(t):
    return C.cleansing_report(bronze_feed(t), silver(t))


LI = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@query("etl_dedup_pk", f"""select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
    strftime(l_shipdate, '%Y-%m-%d') as l_shipdate
    from (select *, row_number() over (partition by l_orderkey, l_linenumber order by {', '.join(c + ' desc' for c in LI)}) as r
          from lineitem) x where r = 1""")
def etl_dedup_pk(t):
    return C.dedup_latest(t.lineitem, ["l_orderkey", "l_linenumber"], LI).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", day_text("l_shipdate").alias("l_shipdate"))


@query("etl_hash_pii", f"""select c_custkey, c_mktsegment, sha256(concat('{SALT}', lower(trim(c_name)))) as c_name_hash from customer""")
def etl_hash_pii(t):
    return C.hash_pii(t.customer.select("c_custkey", "c_mktsegment", "c_name"), ["c_name"], SALT)


@query("etl_validate_email", """select c_custkey, email,
    regexp_matches(email, '^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-zA-Z0-9-.]+$') as email_valid from fx_customers""")
def etl_validate_email(t):
    return t.fx_customers.select("c_custkey", "email", C.email_valid("email").alias("email_valid"))


def mixed_dates(t):
    m = F.col("o_orderkey") % 4
    return t.orders.select("o_orderkey", F.when(m == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
                           .when(m == 1, F.date_format("o_orderdate", "dd/MM/yyyy"))
                           .when(m == 2, F.date_format("o_orderdate", "yyyyMMdd")).otherwise("n/a").alias("raw"))


@query("etl_standardize_dates", """select o_orderkey, raw, strftime(coalesce(try_strptime(raw, '%Y-%m-%d'),
      try_strptime(raw, '%d/%m/%Y'), try_strptime(raw, '%Y%m%d')), '%Y-%m-%d') as d
    from (select o_orderkey, case o_orderkey % 4 when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then strftime(o_orderdate, '%d/%m/%Y')
      when 2 then strftime(o_orderdate, '%Y%m%d') else 'n/a' end as raw from orders) x""")
def etl_standardize_dates(t):
    return mixed_dates(t).withColumn("d", day_text(C.standard_date("raw")))


@query("etl_drop_test_accounts", "select c_custkey, email from fx_customers where not is_test")
def etl_drop_test_accounts(t):
    return C.drop_test_accounts(t.fx_customers, F.col("is_test")).select("c_custkey", "email")


@query("etl_clean_nulls", """select o_orderkey, nullif(trim(raw), '') as cleaned, coalesce(nullif(trim(raw), ''), 'UNKNOWN') as filled
    from (select o_orderkey, case when o_orderkey % 7 = 0 then '  ' when o_orderkey % 11 = 0 then null
      else concat(' ', o_orderpriority, ' ') end as raw from orders) x""")
def etl_clean_nulls(t):
    raw = F.when(F.col("o_orderkey") % 7 == 0, "  ").when(F.col("o_orderkey") % 11 == 0, None).otherwise(
        F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")))
    return t.orders.select("o_orderkey", raw.alias("raw")).select(
        "o_orderkey", C.blank_to_null("raw").alias("cleaned")).withColumn("filled", F.coalesce("cleaned", F.lit("UNKNOWN")))


def requests(t):
    return t.events.select(
        "event_id",
        F.array(F.col("event_type"), F.lit("user_id"), F.when(F.col("value") > 50, "value").otherwise("ts")).alias("requested"),
        F.array(F.lit("user_id"), F.lit("ts"), F.lit("purchase")).alias("required"))


REQ_SQL = """(select event_id, [event_type, 'user_id', case when value > 50 then 'value' else 'ts' end] as requested,
    ['user_id', 'ts', 'purchase'] as required from events) q"""


@query("gov_minimise_columns", """select event_id,
    concat_ws(',', case when event_type <> 'purchase' then event_type end, case when value > 50 then 'value' end) as extra,
    event_type = 'purchase' and value <= 50 as allowed from events""")
def gov_minimise_columns(t):
    extra = G.extra_fields(F.col("requested"), F.col("required"))
    return requests(t).select("event_id", F.array_join(extra, ",").alias("extra"), (F.size(extra) == 0).alias("allowed"))


@query("set_except_fields", f"""select distinct field from (select unnest(requested) as field from {REQ_SQL})
    except select distinct field from (select unnest(required) as field from {REQ_SQL})""")
def set_except_fields(t):
    r = requests(t)
    return r.select(F.explode("requested").alias("field")).distinct().exceptAll(r.select(F.explode("required").alias("field")).distinct())


def kept(t):
    kind = (F.when(F.col("o_orderpriority").startswith("1"), "customer_data").when(F.col("o_orderpriority").startswith("2"), "temp_data")
            .when(F.col("o_orderpriority").startswith("3"), "model_predictions").when(F.col("o_orderpriority").startswith("4"), "audit_logs")
            .otherwise("other"))
    return t.orders.select("o_orderkey", kind.alias("data_type"), ((F.col("o_orderkey") * 37) % 3000).cast("int").alias("days"))


@query("gov_retention_check", """select o_orderkey, data_type, days, days <= coalesce(p.max_days, 365) as compliant
    from (select o_orderkey, case left(o_orderpriority, 1) when '1' then 'customer_data' when '2' then 'temp_data'
      when '3' then 'model_predictions' when '4' then 'audit_logs' else 'other' end as data_type,
      cast((o_orderkey * 37) % 3000 as int) as days from orders) o
    left join (values ('customer_data', 2555), ('transaction_data', 2555), ('model_predictions', 365), ('audit_logs', 2555),
      ('temp_data', 90)) p(kind, max_days) on p.kind = o.data_type""")
def gov_retention_check(t):
    return kept(t).withColumn("compliant", G.retention_ok(F.col("data_type"), F.col("days")))


@query("gov_retention_expire", """select strftime(o_orderdate, '%Y') as yr,
    case when datediff('day', o_orderdate, timestamp '2002-06-30') > 2555 then 'expired'
         when datediff('day', o_orderdate, timestamp '2002-06-30') > 90 then 'archive' else 'keep' end as tier,
    count(*) as n, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total from orders group by 1, 2""")
def gov_retention_expire(t):
    d = F.col("o_orderdate").cast("date")
    tier = F.when(G.expired(d, "2002-06-30", 2555), "expired").when(G.expired(d, "2002-06-30", 90), "archive").otherwise("keep")
    return t.orders.groupBy(F.date_format("o_orderdate", "yyyy").alias("yr"), tier.alias("tier")).agg(
        F.count("*").alias("n"), money_sum("o_totalprice").alias("total"))


@query("gov_lawful_basis", """select event_id, case when event_type = 'purchase' then 'contract_fulfillment' when event_type = 'signup' then 'consent'
      else event_type end as purpose from events
    where event_type in ('purchase', 'signup') or user_id % 2 = 0""")
def gov_lawful_basis(t):
    purpose = F.when(F.col("event_type") == "purchase", "contract_fulfillment").when(F.col("event_type") == "signup", "consent").otherwise(F.col("event_type"))
    e = t.events.select("event_id", purpose.alias("purpose"), (F.col("user_id") % 2 == 0).alias("consent"))
    return e.where(G.lawful(F.col("purpose"), F.col("consent"))).select("event_id", "purpose")


@query("gov_erasure", """select o_orderkey, o_custkey from orders
    where o_custkey not in (select c_custkey from customer where c_acctbal < 0)""")
def gov_erasure(t):
    gone = t.customer.where("c_acctbal < 0").select("c_custkey")
    return G.erase(t.orders.select("o_orderkey", "o_custkey"), gone, "o_custkey", "c_custkey")


@query("gov_path_safe", """select page_id, path, not (contains(path, '..') or starts_with(path, '/')) as safe
    from (select page_id, concat(case page_id % 5 when 0 then '/' when 1 then '../' else '' end,
      regexp_replace(url, '^https?://', '')) as path from pages) x""")
def gov_path_safe(t):
    lead = F.when(F.col("page_id") % 5 == 0, "/").when(F.col("page_id") % 5 == 1, "../").otherwise("")
    p = t.pages.select("page_id", F.concat(lead, F.regexp_replace("url", "^https?://", "")).alias("path"))
    return p.withColumn("safe", G.path_safe(F.col("path")))


@query("gov_size_limit", """select source, cast(sum(n_chars) as bigint) as size_bytes,
    sum(n_chars) / 1048576e0 > 0.1 as over_limit from documents group by source""")
def gov_size_limit(t):
    return G.over_size(t.documents, "source", "n_chars", 0.1)


@query("cat_enum_valid", """select o_orderstatus, o_orderstatus in ('F', 'O') as valid, count(*) as n from orders group by 1, 2""")
def cat_enum_valid(t):
    return t.orders.groupBy("o_orderstatus", F.col("o_orderstatus").isin("F", "O").alias("valid")).agg(F.count("*").alias("n"))


@query("gov_k_anonymity", """select min(n) as k_min, count(*) as n_groups, cast(count(*) filter (where n < 10) as bigint) as groups_below_k,
    cast(coalesce(sum(case when n < 10 then n end), 0) as bigint) as rows_below_k
    from (select c_nationkey, c_mktsegment, count(*) as n from customer group by 1, 2) g""")
def gov_k_anonymity(t):
    return G.k_anonymity(t.customer, ["c_nationkey", "c_mktsegment"], 10)


@query("gov_audit_completeness", """select count(*) as expected, count(a.run_id) as present,
    round(count(a.run_id) / cast(count(*) as double), 6) as coverage
    from fx_task_log l left join (select distinct run_id from fx_task_log where latency_ms > 1) a on l.run_id = a.run_id""")
def gov_audit_completeness(t):
    log = t.fx_task_log
    return G.coverage(log, log.where("latency_ms > 1"), "run_id")


@query("gov_audit_log", """select agent, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as ts, run_id, status, latency_ms
    from (select *, row_number() over (partition by agent order by ts desc, run_id desc) as r from fx_task_log) x where r = 1""")
def gov_audit_log(t):
    s = G.latest_state(t.fx_task_log.select("agent", "ts", "run_id", "status", "latency_ms"), "agent", ["ts", "run_id"])
    return s.select("agent", ts_text("ts").alias("ts"), "run_id", "status", "latency_ms")


@query("gov_access_audit", """with d as (select user_id, cast(ts as date) as ds, count(*) as n from events group by 1, 2),
    m as (select user_id, median(n) as med from d group by 1),
    a as (select d.user_id, median(abs(d.n - m.med)) as mad from d join m on d.user_id = m.user_id group by 1),
    z as (select d.user_id, d.ds, d.n, case when mad > 0 then 0.6745e0 * (n - med) / mad end as z
          from d join m on d.user_id = m.user_id join a on d.user_id = a.user_id)
    select user_id, strftime(ds, '%Y-%m-%d') as ds, cast(null as varchar) as resource, n, 'volume' as reason from z where z > 3.5
    union all
    select e.user_id, null, e.event_type, count(*), 'no_grant' from events e
    where not exists (select 1 from events g where g.user_id = e.user_id and g.event_type = e.event_type and g.ts < timestamp '2024-01-08')
    group by e.user_id, e.event_type""")
def gov_access_audit(t):
    from voltlake.operators.privacy import suspicious_access

    e = t.events.select("user_id", F.col("event_type").alias("resource"), "ts")
    return suspicious_access(e, e.where(F.col("ts") < F.lit("2024-01-08").cast("timestamp_ntz")), 3.5)
