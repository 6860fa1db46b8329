"""Personal data, compliance, catalogue and lineage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from voltlake.functions.scalars import r6, ts_text
from voltlake.operators import catalog as K
from voltlake.operators import governance as G
from voltlake.operators import privacy as P
from voltlake.operators.aggregates import row_stats
from voltlake.plans.p_cleanse import kept, requests, silver
from voltlake.plans.p_windows import EDGES_SQL, NODES_SQL, lineage_edges
from voltlake.plans.registry import query
from voltlake.session import scratch
from voltlake.tables import SCHEMAS

FIELD_NAMES = ["email_hash", "amount", "Phone", "Home_Address", "ts", "iban"]


@query("pii_schema_flag", f"""select name, count(*) as n, regexp_matches(lower(name), '{'|'.join(P.PII_WORDS)}') as pii
    from (select concat(event_type, '_', ({FIELD_NAMES!r})[1 + user_id % 6]) as name from events) x group by name""")
def pii_schema_flag(t):
    names = F.element_at(F.array(*[F.lit(n) for n in FIELD_NAMES]), (1 + F.col("user_id") % 6).cast("int"))
    cols = t.events.select(F.concat("event_type", F.lit("_"), names).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    return cols.withColumn("pii", P.name_is_pii(F.col("name")))


def scan_sql(sources, patterns):
    """``sources`` holds (table, column, field)."""
    one = [f"""select '{f}' as field, '{k}' as type, cast(coalesce(sum(len(regexp_extract_all({c}, '{p}'))), 0) as bigint) as count,
        '{P.SEVERITY.get(k, 'high')}' as severity from {tab}""" for tab, c, f in sources for k, p in patterns.items()]
    return " union all ".join(one)


@query("pii_scan_values", scan_sql([("documents", "text", "text"), ("documents", "source", "source"), ("pages", "html", "html"), ("pages", "url", "url")], P.AUDIT_PATTERNS))
def pii_scan_values(t):
    return P.scan_values(t.documents, ["text", "source"], P.AUDIT_PATTERNS).unionByName(P.scan_values(t.pages, ["html", "url"], P.AUDIT_PATTERNS))


@query("pii_scan_catalog", scan_sql([("documents", "text", "text"), ("conversations", "text", "message")], P.CATALOG_PATTERNS))
def pii_scan_catalog(t):
    chats = t.conversations.select(F.col("text").alias("message"))
    return P.scan_values(t.documents, ["text"], P.CATALOG_PATTERNS).unionByName(P.scan_values(chats, ["message"], P.CATALOG_PATTERNS))


@query("pii_violations", f"""select field, type, 'Unmasked PII in data layer' as violation, 'Apply hashing or tokenization' as recommendation
    from ({scan_sql([('documents', 'text', 'text'), ('pages', 'html', 'phone_hash'), ('pages', 'url', 'url')], P.AUDIT_PATTERNS)}) f
    where count > 0 and field not in ('customer_email_hash', 'phone_hash')""")
def pii_violations(t):
    pages = t.pages.select(F.col("html").alias("phone_hash"), "url")
    return P.violations(P.scan_values(t.documents, ["text"], P.AUDIT_PATTERNS).unionByName(P.scan_values(pages, ["phone_hash", "url"], P.AUDIT_PATTERNS)))


@query("pii_row_guard", f"""select 'documents' as dataset, doc_id as id from documents
      where {' or '.join(f"regexp_matches(text, '{p}')" for p in P.GUARD_PATTERNS.values())}
    union all select 'pages', page_id from pages where {' or '.join(f"regexp_matches(html, '{p}')" for p in P.GUARD_PATTERNS.values())}""")
def pii_row_guard(t):
    d = t.documents.select("doc_id", "text").where(P.has_pii(F.col("text"))).select(F.lit("documents").alias("dataset"), F.col("doc_id").alias("id"))
    return d.unionByName(t.pages.select("page_id", "html").where(P.has_pii(F.col("html"))).select(F.lit("pages").alias("dataset"), F.col("page_id").alias("id")))


def mask_sql(c):
    return reduce(lambda s, kv: f"regexp_replace({s}, '{kv[1]}', '[{kv[0].upper()}]', 'g')", P.AUDIT_PATTERNS.items(), c)


@query("pii_mask", f"select doc_id, sha256({mask_sql('text')}) as masked_sha, len({mask_sql('text')}) as masked_len from documents")
def pii_mask(t):
    m = t.documents.select("doc_id", "text").select("doc_id", P.mask(F.col("text")).alias("m"))
    return m.select("doc_id", F.sha2("m", 256).alias("masked_sha"), F.length("m").cast("long").alias("masked_len"))


@query("pii_coverage", """select count(*) as expected, count(s.source) as present, round(count(s.source) / cast(count(*) as double), 6) as coverage
    from (select distinct source from documents) d left join (select distinct source from documents join labels using (doc_id) where toxic = 1) s
    on d.source = s.source""")
def pii_coverage(t):
    scanned = t.documents.join(t.labels.where("toxic = 1"), "doc_id", "left_semi").select("source")
    return G.coverage(t.documents, scanned, "source")


@query("pii_eval", """with h as (select contains(text, '@') as truth, regexp_matches(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}') as hit from documents),
    c as (select cast(count(*) filter (where hit and truth) as bigint) as tp, cast(count(*) filter (where hit and not truth) as bigint) as fp,
      cast(count(*) filter (where not hit and truth) as bigint) as fn, cast(count(*) filter (where not hit and not truth) as bigint) as tn from h)
    select tp, fp, fn, tn, round(tp / cast(nullif(tp + fn, 0) as double), 6) as recall,
      round(fp / cast(nullif(fp + tn, 0) as double), 6) as false_positive_rate from c""")
def pii_eval(t):
    return P.detector_scores(t.documents, F.col("text").rlike(P.AUDIT_PATTERNS["email"]), F.col("text").contains("@"))


@query("gov_compliance_report", """with c as (
      select (select bool_and(event_type = 'purchase' and value <= 50) from events) as data_minimization,
        (select bool_and(event_type in ('purchase', 'signup') or user_id % 2 = 0) from events) as purpose_limitation,
        (select bool_and((o_orderkey * 37) % 3000 <= case left(o_orderpriority, 1) when '1' then 2555 when '2' then 90 when '3' then 365
           when '4' then 2555 else 365 end) from orders) as storage_limitation,
        true as integrity_confidentiality)
    select *, round((data_minimization::int + purpose_limitation::int + storage_limitation::int + integrity_confidentiality::int) / 4e0, 6)
      as compliance_score from c""")
def gov_compliance_report(t):
    minimal = requests(t).agg(F.min(F.size(G.extra_fields(F.col("requested"), F.col("required"))) == 0).alias("ok"))
    purpose = F.when(F.col("event_type") == "purchase", "contract_fulfillment").when(F.col("event_type") == "signup", "consent").otherwise(F.col("event_type"))
    lawful = t.events.agg(F.min(G.lawful(purpose, F.col("user_id") % 2 == 0)).alias("ok"))
    stored = kept(t).agg(F.min(G.retention_ok(F.col("data_type"), F.col("days"))).alias("ok"))
    hashed = silver(t).agg((F.coalesce(F.sum(F.regexp_count("email_hash", F.lit(P.AUDIT_PATTERNS["email"]))), F.lit(0)) == 0).alias("ok"))
    checks = {"data_minimization": minimal, "purpose_limitation": lawful, "storage_limitation": stored, "integrity_confidentiality": hashed}
    rows = K.union_all([d.select(F.lit(n).alias("check"), "ok") for n, d in checks.items()])
    return rows.agg(*[F.max(F.when(F.col("check") == n, F.col("ok"))).alias(n) for n in checks], r6(F.avg(F.col("ok").cast("double"))).alias("compliance_score"))


# catalogue -----------------------------------------------------------------------------------------------------------


COUNTS_SQL = " union all ".join(f"select '{n}' as \"table\", count(*) as \"rows\" from {n}" for n in sorted(SCHEMAS))


@query("cat_discover", f"""with c as (select table_name as "table", string_agg(column_name, ',' order by ordinal_position) as columns from information_schema.columns group by 1)
    select 'bronze' as database, n."table", 'parquet' as format, '' as partitions, columns, "rows" from ({COUNTS_SQL}) n join c using ("table")""")
def cat_discover(t):
    entries = K.discover(t.spark, t.path, "bronze", sorted(SCHEMAS))
    counts = K.union_all([getattr(t, n).agg(F.count("*").alias("rows")).withColumn("table", F.lit(n)) for n in sorted(SCHEMAS)])
    found = entries.join(F.broadcast(counts), "table")  # one row per dataset
    return found.select("database", "table", "format", F.array_join("partitions", ",").alias("partitions"), F.array_join(F.transform("schema", lambda c: c["name"]), ",").alias("columns"), "rows")


def source_entries(t):
    """One catalogue entry per document source."""
    g = t.documents.groupBy("source").agg(F.max("n_chars").alias("m"))
    col_ = lambda n, ty: F.struct(F.lit(n).alias("name"), F.lit(ty).alias("type"), F.lit(None).cast("boolean").alias("pii"))
    return g.select(
        F.lit("bronze").alias("database"), F.col("source").alias("table"), F.format_string("s3://lake/bronze/%s/", "source").alias("location"),
        F.when(F.col("m") % 2 == 0, "parquet").otherwise("csv").alias("format"), F.array(F.lit("ds"), F.lit("lang")).alias("partitions"),
        F.when(F.col("m") % 3 != 0, F.array(col_("doc_id", "bigint"), col_("email_hash", "string"))).alias("schema"))


@query("cat_update", """select 'bronze' as database, source as name, concat('s3://lake/bronze/', source, '/') as location,
      case when max(n_chars) % 2 = 0 then 'parquet' else 'json' end as input_format,
      case when max(n_chars) % 3 <> 0 then 'doc_id:bigint,email_hash:string' else '' end as columns,
      'ds:string,lang:string' as partition_keys from documents group by source""")
def cat_update(t):
    r = K.catalog_records(source_entries(t), F.lit("2024-01-31T00:00:00"))
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["Name"], F.lit(":"), x["Type"])), ",")
    return r.select(
        F.col("DatabaseName").alias("database"), F.col("Name").alias("name"), F.col("StorageDescriptor.Location").alias("location"),
        F.col("StorageDescriptor.InputFormat").alias("input_format"), text("StorageDescriptor.Columns").alias("columns"), text("PartitionKeys").alias("partition_keys"))


@query("cat_schema_card")
def cat_schema_card(t):
    stats = row_stats(t.events, "ts", "2024-01-31 00:00:00").withColumn("last_modified", ts_text("last_modified"))
    cols = K.columns_of(t.events, "events").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "type", P.name_is_pii(F.col("name")).alias("pii")))).alias("schema"))
    edges = K.lineage_graph(lineage_edges(t), "event_no")[1]
    here = F.lit("s3://lake/silver/nation_3/")
    near = edges.where((F.col("source") == here) | (F.col("target") == here)).agg(
        F.array_sort(F.collect_set(F.when(F.col("target") == here, F.col("source")))).alias("upstream"),
        F.array_sort(F.collect_set(F.when(F.col("source") == here, F.col("target")))).alias("downstream"))
    one = lambda d, n: d.select(F.lit("events").alias("table"), F.struct("*").alias(n))
    card = one(stats, "statistics").join(one(cols, "columns"), "table").join(one(near, "lineage"), "table")
    return card.select("table", F.to_json(F.struct("*")).alias("card"))


@query("lin_build_graph", f"""with e as ({EDGES_SQL}), n as ({NODES_SQL})
    select e.source_uri as source, s.layer as source_layer, e.target_uri as target, g.layer as target_layer, transformation,
      count(*) as n, strftime(max(ts), '%Y-%m-%d') as last_seen
    from e join n s on s.id = e.source_uri join n g on g.id = e.target_uri group by all""")
def lin_build_graph(t):
    nodes, edges = K.lineage_graph(lineage_edges(t), "event_no")
    counted = edges.groupBy("source", "target", "transformation").agg(F.count("*").alias("n"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_seen"))
    src = nodes.select(F.col("id").alias("source"), F.col("layer").alias("source_layer"))
    tgt = nodes.select(F.col("id").alias("target"), F.col("layer").alias("target_layer"))
    return counted.join(src, "source").join(tgt, "target")


@query("lin_extract_layer", f"""with e as ({EDGES_SQL}) select event_no, case when target_uri like '%/bronze/%' then 'bronze'
    when target_uri like '%/silver/%' then 'silver' when target_uri like '%/gold/%' then 'gold' else 'unknown' end as layer from e""")
def lin_extract_layer(t):
    return lineage_edges(t).select("event_no", K.layer(F.col("target_uri")).alias("layer"))


@query("lin_neighbours", f"""with recursive e as (select distinct source_uri as a, target_uri as b from ({EDGES_SQL}) x),
    r(root, node, depth) as (select distinct a, a, 0 from e where contains(a, '/bronze/')
      union select r.root, e.b, r.depth + 1 from r join e on r.node = e.a where r.depth < 6)
    select root, node, min(depth) as depth from r where not (root = node) group by 1, 2""")
def lin_neighbours(t):
    edges = K.lineage_graph(lineage_edges(t), "event_no")[1]
    seeds = edges.where(F.col("source").contains("/bronze/")).select(F.col("source").alias("id")).distinct()
    return K.reach(edges, seeds)


@query("lin_emit", """select 'orders.parquet' as source_uri, 'copy_orders' as transformation, 'etl' as agent_name, 'run-1' as run_id, count(*) as records_out,
    '2024-01-31T00:00:00' as timestamp, count(*) as rows_written from orders""")
def lin_emit(t):
    from voltlake.sources.files import append_lineage, run_with_lineage

    out = scratch(t.spark, "lineage")
    counted = run_with_lineage(t.orders, f"{out}/silver/orders", t.file("orders"), "copy_orders", "run-1")
    append_lineage(counted, f"{out}/lineage")
    written = t.spark.read.parquet(f"{out}/silver/orders").agg(F.count("*"))
    name = F.regexp_extract("source_uri", "([^/]+)$", 1).alias("source_uri")
    return t.spark.read.parquet(f"{out}/lineage").select(name, "transformation", "agent_name", "run_id", "records_out", "timestamp", written.scalar().alias("rows_written"))


@query("lin_completeness", f"""with e as ({EDGES_SQL}), d as (select distinct concat('s3://lake/silver/nation_', n_nationkey, '/') as id from nation
      union select distinct concat('s3://lake/raw/', source, '/') from documents)
    select count(*) as expected, cast(count(*) filter (where id in (select target_uri from e)) as bigint) as present,
      round(count(*) filter (where id in (select target_uri from e)) / cast(count(*) as double), 6) as coverage from d""")
def lin_completeness(t):
    have = lineage_edges(t).select(F.col("target_uri").alias("id"))
    need = t.nation.select(F.format_string("s3://lake/silver/nation_%d/", "n_nationkey").alias("id")).unionByName(
        t.documents.select(F.format_string("s3://lake/raw/%s/", "source").alias("id")))
    return G.coverage(need, have, "id")
