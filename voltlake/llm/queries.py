"""The registered query of each text operator, with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlake.llm import fingerprints as fp
from voltlake.llm import decontaminate, html_extract, langid, mixing, neardup, periodic, prefix_trie, quality, suffix_dedup, token_counts, url_filter, warc
from voltlake.llm.common import lake

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap


@query("op7_fingerprints")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fp.fingerprints(lake(spark, sf_dir).documents)


@query("op8_warc", """
with p as (select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as payload_bytes from pages),
f as (select *, min(page_id) over (partition by html) as first from p),
d as (select *, list_transform(range(0, 20), lambda i: ('0x' || substr(sha1(html), 2 * i::integer + 1, 2))::integer) as b from f),
e as (select *, list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (((b[1 + (5 * i) // 8] * 256 + coalesce(b[2 + (5 * i) // 8], 0)) >> (11 - (5 * i) % 8)) & 31)::integer, 1)) as t from d)
select page_id, payload_bytes, array_to_string(t, '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id = first then null else first end as refers_to from e""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archive_and_read(lake(spark, sf_dir).pages)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op4_mixing", mixing.mix_sql())
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(lake(spark, sf_dir).documents)


@query("op6_decontaminate")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lake(spark, sf_dir)
    out = decontaminate.decontaminate(t.documents.select("doc_id", "text"), t.benchmark, texts=False)
    return out.select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op9_quality")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lake(spark, sf_dir)
    return quality.classify(t.documents, t.labels).select("doc_id", "log_weight", "score", "kept")


@query("op10_neardup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(lake(spark, sf_dir).documents).select("doc_id", "n_shingles", "component_id", "kept")


@query("op1_suffix_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.repeats(lake(spark, sf_dir).documents, words=51)  # passages of over 50 words
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words")


@query("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(lake(spark, sf_dir).documents)


@query("op3_html_extract")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(lake(spark, sf_dir).pages)


@query("op5_langid")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(lake(spark, sf_dir).documents).select("doc_id", "held_out", "lang_pred", "score")


@query("op11_url_filter", url_filter.judge_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(lake(spark, sf_dir).pages).select("page_id", "host", "path", "rule", "verdict")


@query("op12_prefix_trie", prefix_trie.prefix_trie_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(lake(spark, sf_dir).conversations)


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic_runs(lake(spark, sf_dir).documents, planted=True, texts=False).drop("clean_text")
