"""Sources and sinks: each write is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltlake.functions.scalars import ds_text, money_sum, share
from voltlake.operators import catalog as K
from voltlake.plans.registry import query
from voltlake.session import scratch
from voltlake.sources import files as S
from voltlake.sources import kv
from voltlake.tables import SCHEMAS


def landed_events(t):
    """Events as day partitions in a new folder."""
    out = scratch(t.spark, "events")
    S.write_partitioned(t.events.withColumn("ds", ds_text("ts")), out)
    return out


@query("src_batch_bronze", """select o_orderkey, o_custkey, o_totalprice, strftime(date_trunc('month', o_orderdate), '%Y%m%d') as ds, (select count(*) from orders) as records_ingested, true as bytes_known from orders""")
def src_batch_bronze(t):
    out = scratch(t.spark, "bronze")
    report = S.land(t.orders.withColumn("month", F.trunc("o_orderdate", "month")), out, "month")
    return t.spark.read.parquet(out).select("o_orderkey", "o_custkey", "o_totalprice", F.col("ds").cast("string").alias("ds"),
                                            F.lit(report["records_ingested"]).cast("long").alias("records_ingested"), F.lit(report["bytes_written"] > 0).alias("bytes_known"))


@query("src_incremental", "select event_id, value from events where ts >= timestamp '2024-01-20'")
def src_incremental(t):
    cut = F.lit("2024-01-20").cast("timestamp_ntz")
    # the rows at the mark itself are partly landed
    landed = t.events.where(F.col("ts") < cut).select("event_id", "ts")
    return S.incremental(t.events, landed, "ts", "event_id").select("event_id", "value")


@query("src_ingest_dedup", """select count(*) as records, count(distinct (l_orderkey, l_linenumber)) as distinct_records,
    round(1 - count(distinct (l_orderkey, l_linenumber)) / cast(count(*) as double), 6) as duplicate_rate,
    1 - count(distinct (l_orderkey, l_linenumber)) / cast(count(*) as double) <= 0.001 as within_target from lineitem""")
def src_ingest_dedup(t):
    return S.duplicate_rate(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("src_schema_gate", """with n as (select count(*) as n from events), d as (select strftime(ts, '%Y%m%d') as ds, count(*) as landed from events group by 1)
    select ds, landed, name, declared, actual, problem, n as rows_offered from n, d, (values ('extra', null, 'int', 'unexpected'),
    ('props', 'string', null, 'missing'), ('value', 'double', 'string', 'type')) v(name, declared, actual, problem)""")
def src_schema_gate(t):
    """A batch that fits is landed; one that does not is refused whole, and the table still holds what it held."""
    out = scratch(t.spark, "gated")
    stored = t.spark.read.parquet(t.file("events"))
    good = stored.withColumn("ds", ds_text("ts"))
    S.gated_write(good, good.schema, out)
    try:
        S.gated_write(good.withColumn("value", F.col("value").cast("string")).withColumn("extra", F.lit(1)).drop("props"), good.schema, out)
    except S.SchemaRefused as refused:
        bad = refused.violations
    landed = t.spark.read.parquet(out).groupBy(F.col("ds").cast("string").alias("ds")).agg(F.count("*").alias("landed"))
    problems = bad.agg(F.collect_list(F.struct("name", "declared", "actual", "problem")).alias("p"))  # one row
    return landed.select("ds", "landed", F.inline(problems.scalar())).withColumn("rows_offered", stored.agg(F.count("*")).scalar())


KINDS_SQL = """case data_type when 'BIGINT' then 'bigint' when 'VARCHAR' then 'string' when 'DOUBLE' then 'double' else lower(data_type) end"""


@query("src_schema_diff", f"""with c as (select column_name as name, {KINDS_SQL} as type from duckdb_columns() where table_name = 'orders'),
    n as (select count(o_orderpriority) as priority, count(*) as rows, count(o_totalprice) as price from orders)
    select 'orders' as dataset, name, type as old_type, case name when 'o_totalprice' then 'decimal(18,2)' end as new_type, case name when 'o_totalprice' then 'retyped' else 'removed' end as change,
      case name when 'o_totalprice' then price else priority end as old_values, case name when 'o_totalprice' then price else 0 end as new_values
    from c, n where name in ('o_orderpriority', 'o_totalprice')
    union all select 'orders', 'o_channel', null, 'string', 'added', 0, rows from n""")
def src_schema_diff(t):
    """Two stored versions of a table: the columns that differ in their files, with the values each version holds."""
    out = scratch(t.spark, "versions")
    t.spark.read.parquet(t.file("orders")).write.parquet(f"{out}/v1")
    old = t.spark.read.parquet(f"{out}/v1")
    old.drop("o_orderpriority").withColumn("o_channel", F.lit("web")).withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)")).write.parquet(f"{out}/v2")
    a, b = (K.column_values(t.spark.read.parquet(f"{out}/{v}"), "orders") for v in ("v1", "v2"))
    diff = K.schema_diff(a, b)
    values = lambda d, n: d.select(F.col("name").alias(f"_{n}"), F.col("values").alias(n))
    diff = diff.join(values(a, "old_values"), F.col("name") == F.col("_old_values"), "left").join(values(b, "new_values"), F.col("name") == F.col("_new_values"), "left")
    zero = F.lit(0).cast("long")
    return diff.select("dataset", "name", "old_type", "new_type", "change", F.coalesce("old_values", zero).alias("old_values"), F.coalesce("new_values", zero).alias("new_values"))


@query("src_dead_letter", """select event_id, event_id % 9 = 0 as dead, case when event_id % 9 <> 0 then cast(json_extract_string(props, '$.k') as int) end as k from events""")
def src_dead_letter(t):
    raw = t.events.select("event_id", F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("{broken "), "props")).otherwise(F.col("props")).alias("props"))
    out = scratch(t.spark, "dead-letter")
    good, dead = S.dead_letter(raw, "props", "k int")
    good.write.parquet(f"{out}/good")
    dead.write.parquet(f"{out}/dead")
    g = t.spark.read.parquet(f"{out}/good").select("event_id", F.lit(False).alias("dead"), "k")
    return g.unionByName(t.spark.read.parquet(f"{out}/dead").select("event_id", F.lit(True).alias("dead"), F.lit(None).cast("int").alias("k")))


@query("src_scan_formats", """select format, c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer cross join (values ('parquet'), ('csv'), ('json'), ('orc')) f(format)""")
def src_scan_formats(t):
    out = scratch(t.spark, "formats")
    frames = []
    for f in ("parquet", "csv", "json", "orc"):
        t.customer.write.format(f).save(f"{out}/{f}")
        frames.append(t.spark.read.format(f).schema(SCHEMAS["customer"]).load(f"{out}/{f}").select(F.lit(f).alias("format"), *t.customer.columns))
    return K.union_all(frames)


@query("src_read_json", "select source, count(*) as n, cast(sum(n_chars) as bigint) as chars from documents group by 1")
def src_read_json(t):
    out = scratch(t.spark, "json")
    S.write_json(t.documents, out)
    return S.read_json(t.spark, out, SCHEMAS["documents"]).groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("src_write_json", "select doc_id, text, lang from documents")
def src_write_json(t):
    out = S.write_json(t.documents.select("doc_id", "text", "lang"), scratch(t.spark, "json"))
    return S.read_json(t.spark, out, "doc_id long, text string, lang string")


@query("src_write_text", "select sha256(line) as sha, count(*) as n from (select replace(item.text, chr(10), ' ') as line from benchmark item) x group by 1")
def src_write_text(t):
    out = S.write_text(t.benchmark.select(F.replace("text", F.lit("\n"), F.lit(" ")).alias("line")), "line", scratch(t.spark, "text"))
    return S.read_text(t.spark, out).groupBy(F.sha2("value", 256).alias("sha")).agg(F.count("*").alias("n"))


@query("src_read_text", "select cast(sum(len(text) + 1) as bigint) as chars from conversations")
def src_read_text(t):
    out = S.write_text(t.conversations, "text", scratch(t.spark, "text"))
    return S.read_text(t.spark, out, whole=True).agg(F.sum(F.length("value")).cast("long").alias("chars"))


def event_keys(t):
    """Day folders of the landed events as object keys."""
    return S.list_objects(t.spark, landed_events(t), "ds=202401")


@query("src_list_objects", "select distinct strftime(ts, 'ds=%Y%m%d') as folder from events where strftime(ts, '%Y%m') = '202401'")
def src_list_objects(t):
    return event_keys(t).select(F.element_at(F.split("key", "/"), 1).alias("folder")).distinct()


@query("src_object_exists", """select strftime(d, '%Y%m%d') as ds, cast(d as date) in (select distinct cast(ts as date) from events) as "exists"
    from (select unnest(generate_series(timestamp '2024-01-25', timestamp '2024-02-05', interval 1 day)) as d) x""")
def src_object_exists(t):
    days = t.spark.range(1).select(F.explode(F.sequence(F.lit("2024-01-25").cast("date"), F.lit("2024-02-05").cast("date"))).alias("d"))
    have = S.listing(t.spark, landed_events(t)).select(F.regexp_extract("path", r"ds=(\d{8})", 1).alias("key"))
    return S.exists(days.select(F.date_format("d", "yyyyMMdd").alias("key")), have).withColumnRenamed("key", "ds")


@query("src_kv_get", "select * from customer where c_custkey = 42")
def src_kv_get(t):
    return kv.get(t.customer, {"c_custkey": 42})


@query("src_kv_put", """select o_orderkey, o_custkey, case when o_orderkey % 10 = 0 then 'X' else o_orderstatus end as o_orderstatus, case when o_orderkey % 10 = 0 then o_totalprice + 2 else o_totalprice end as o_totalprice from orders
    union all select o_orderkey + 10000000, o_custkey, 'N', o_totalprice + 1 from orders where o_orderkey % 1000 = 0""")
def src_kv_put(t):
    base = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    change = lambda n, s: base.where("o_orderkey % 10 = 0").withColumns({"o_orderstatus": F.lit(s), "o_totalprice": F.col("o_totalprice") + n, "v": F.lit(n)})
    new = base.where("o_orderkey % 1000 = 0").withColumns({"o_orderkey": F.col("o_orderkey") + 10_000_000, "o_orderstatus": F.lit("N"), "o_totalprice": F.col("o_totalprice") + 1, "v": F.lit(1)})
    return kv.put(base, change(1, "W").unionByName(change(2, "X")).unionByName(new), ["o_orderkey"], "v")


@query("src_kv_update", """select c_custkey, c_name, case when c_custkey % 4 = 0 then null when c_custkey % 4 = 1 then 0 else c_acctbal end as c_acctbal from customer
    union all select c_custkey + 10000000, null, 0 from customer where c_custkey % 100 = 1""")
def src_kv_update(t):
    m = F.col("c_custkey") % 4
    ch = t.customer.where(m <= 2).select("c_custkey", F.when(m == 1, 0.0).alias("c_acctbal"), (m != 2).alias("c_acctbal_set"))
    new = t.customer.where("c_custkey % 100 = 1").select((F.col("c_custkey") + 10_000_000).alias("c_custkey"), F.lit(0.0).alias("c_acctbal"), F.lit(True).alias("c_acctbal_set"))
    return kv.update(t.customer.select("c_custkey", "c_name", "c_acctbal"), ch.unionByName(new), ["c_custkey"], ["c_acctbal"])


@query("src_kv_query", "select o_orderkey, o_custkey, o_totalprice from orders where o_orderstatus = 'F' order by o_orderkey")
def src_kv_query(t):
    return kv.query(t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"), F.col("o_orderstatus") == "F", "o_orderkey").drop("o_orderstatus")


ISO_SQL = "case when epoch_us({c}) % 1000000 = 0 then strftime({c}, '%Y-%m-%dT%H:%M:%S') else strftime({c}, '%Y-%m-%dT%H:%M:%S.%f') end"


@query("src_serialize_ts", f"""select event_id, {ISO_SQL.format(c='ts')} as at, {ISO_SQL.format(c="date_trunc('second', ts)")} as inner_at, {ISO_SQL.format(c='ts')} as listed_at,
    strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as direct from events""")
def src_serialize_ts(t):
    items = t.events.select("event_id", F.col("ts").alias("at"), F.struct(F.date_trunc("second", "ts").alias("at")).alias("inner"),
                            F.array(F.struct(F.col("ts").alias("at"))).alias("listed"), F.array("ts").alias("direct"))
    s = S.serialize_rows(items)
    return s.select("event_id", "at", F.col("inner.at").alias("inner_at"), F.col("listed")[0]["at"].alias("listed_at"), F.date_format(F.col("direct")[0], "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("direct"))


@query("src_quarantine", "select event_id, strftime(ts, '%Y%m%d') as ds, value > 150 as quarantined from events")
def src_quarantine(t):
    out = scratch(t.spark, "quarantine")
    S.quarantine(t.events.withColumn("ds", ds_text("ts")), F.col("value") > 150, f"{out}/clean", f"{out}/quarantine")
    read = lambda p, flag: t.spark.read.parquet(f"{out}/{p}").select("event_id", F.col("ds").cast("string").alias("ds"), F.lit(flag).alias("quarantined"))
    return read("clean", False).unionByName(read("quarantine", True))


@query("src_fallback_partition", """with p as (select cast(ts as date) as d, avg(case when event_type = 'error' then 1e0 else 0e0 end) < 0.18 as ok from events group by 1)
    select event_id, strftime(ts, '%Y%m%d') as ds from events where cast(ts as date) = (select max(d) from p where ok and d <= date '2024-01-28')""")
def src_fallback_partition(t):
    passed = t.events.groupBy(ds_text("ts").alias("ds")).agg((share(F.col("event_type") == "error") < 0.18).alias("passed"))
    return S.fallback_partition(t.spark, landed_events(t), passed, "20240128").select("event_id", F.col("ds").cast("string").alias("ds"))


@query("src_compact", """select strftime(ts, '%Y%m%d') as ds, count(*) as n, cast(sum(cast(value as decimal(18,2))) as double) as total, true as compact from events
    where ts >= timestamp '2024-01-24' group by 1""")
def src_compact(t):
    out = scratch(t.spark, "compact")
    t.events.withColumn("ds", ds_text("ts")).repartition(6).write.partitionBy("ds").parquet(f"{out}/small")
    S.compact(t.spark, f"{out}/small", f"{out}/big", keep_from="20240124")
    files = S.listing(t.spark, f"{out}/big").select(F.regexp_extract("path", r"ds=(\d{8})", 1).alias("ds")).groupBy("ds").agg((F.count("*") == 1).alias("compact"))
    g = t.spark.read.parquet(f"{out}/big").groupBy(F.col("ds").cast("string").alias("ds")).agg(F.count("*").alias("n"), money_sum("value").alias("total"))
    return g.join(files, "ds")


@query("etl_partition_prune", "select event_id, value from events where cast(ts as date) = date '2024-01-10'")
def etl_partition_prune(t):
    return t.spark.read.parquet(landed_events(t)).where("ds = 20240110").select("event_id", "value")

