"""Mixing sources to target weights by Poisson replication.

A document of source s is repeated k times, where k inverts the Poisson distribution with mean rate(s) at a number drawn
from a hash of seed and doc_id. The rate is target characters of the source over its characters, so the expected mix has
the target weights. Every copy gets a hashed key, and the copies are sorted by it: a global shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltlake.llm.common import tasks

#: Shares of the mix; sources that are not named share what is left in proportion to their size.
WEIGHTS = {"src0": 0.2, "src1": 0.1, "src2": 0.08, "src3": 0.02}
SEED = 17
EPOCHS = 1.0
BITS = 52


def rates(docs: DataFrame, weights: dict[str, float], epochs: float) -> dict[str | None, float]:
    """Mean repetitions of each named source, and at None of all others. At most one number a named source is collected."""
    named = F.when(F.col("source").isin(list(weights)), F.col("source"))
    size = {r["s"]: r["n"] for r in docs.groupBy(named.alias("s")).agg(F.sum(F.char_length(F.coalesce("text", F.lit("")))).alias("n")).collect()}
    total = sum(n or 0 for n in size.values())
    left = 1.0 - sum(w for s, w in weights.items() if size.get(s))
    if left < 0:
        raise ValueError("target weights exceed 1")
    out = {s: w * epochs * total / size[s] for s, w in weights.items() if size.get(s)}
    out[None] = left * epochs * total / size[None] if size.get(None) else 0.0
    return out


def thresholds(rate: float) -> list[float]:
    """The distribution function at 0, 1, 2 ... until it reaches 1 in double precision."""
    if rate <= 0:
        return []
    out, sum_, k = [], 0.0, 0
    while True:
        term = math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        sum_ += term
        if k > rate and term < 2.0 ** -(BITS + 2):
            return out
        out.append(min(sum_, 1.0))
        k += 1


def draw(seed: int) -> Column:
    """A number in [0, 1) of BITS bits from the seed and the document; documents without id use their text."""
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce("text", F.lit("")))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), own)), 1, BITS // 4), 16, 10).cast("long") / F.lit(float(1 << BITS))


def mix(docs: DataFrame, weights: dict[str, float] = WEIGHTS, seed: int = SEED, epochs: float = EPOCHS) -> DataFrame:
    """The columns of ``docs`` with copy (from 1), n_copies and shuffle_key, in the order of the key.

    Repeated rows are drawn alike. A null source counts as one that is not named, a null text as empty. Columns of ``docs`` that are named like
    the three new ones give way to them.
    """
    docs = docs.drop("copy", "n_copies", "shuffle_key")
    at = rates(docs, weights, epochs)
    above = lambda r: F.size(F.filter(F.array(*[F.lit(x) for x in thresholds(r)]), lambda c: F.col("_vl_u") >= c)) if r > 0 else F.lit(0)
    count = above(at[None])
    for s in weights:
        if s in at:
            count = F.when(F.col("source") == s, above(at[s])).otherwise(count)
    many = docs.withColumn("_vl_u", draw(seed)).withColumn("n_copies", count.cast("int")).drop("_vl_u").filter("n_copies > 0")
    copies = many.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    own = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(f"order{seed}"), own, F.col("copy").cast("string"))))
    return keyed.repartitionByRange(tasks(docs.sparkSession), "shuffle_key").sortWithinPartitions("shuffle_key")


def mix_sql(docs: str = "documents", weights: dict[str, float] = WEIGHTS, seed: int = SEED, epochs: float = EPOCHS, columns: str = "doc_id, text, lang, source, n_chars") -> str:
    """The same rows in DuckDB's SQL."""
    w = ", ".join(f"('{s}', {x}::double)" for s, x in weights.items())
    cols = ", ".join(f"d.{c.strip()}" for c in columns.split(","))
    return f"""
with recursive docs_ as (select * from {docs}),
weight_ as (select * from (values {w}) v(s, w)),
size_ as (select w.s, sum(length(coalesce(d.text, '')))::double as n from docs_ d left join weight_ w on d.source = w.s group by w.s),
total_ as (select sum(n) as n from size_),
rate_ as (
  select z.s, (case when z.s is null then (select 1.0::double - coalesce(sum(w.w), 0) from weight_ w join size_ y on y.s = w.s and y.n > 0) else w.w end)
         * {epochs}::double * (select n from total_) / z.n as r
  from size_ z left join weight_ w on w.s = z.s where z.n > 0),
cdf_ as (
  select s, r, 0 as k, exp(-r) as c from rate_ where r > 0
  union all
  select s, r, k + 1, c + exp((k + 1) * ln(r) - r - lgamma(k + 2)) from cdf_
  where k + 1 <= r or exp((k + 1) * ln(r) - r - lgamma(k + 2)) >= pow(2.0, -{BITS + 2})),
drawn_ as (
  select d.*, n.s as named_,
    ('0x' || substr(md5('{seed}:' || coalesce(cast(d.doc_id as varchar), 'text:' || md5(coalesce(d.text, '')))), 1, {BITS // 4}))::bigint / {float(1 << BITS)} as u_
  from docs_ d left join weight_ n on d.source = n.s),
counts_ as (select named_, u_, (select count(*) from cdf_ c where c.s is not distinct from x.named_ and x.u_ >= c.c) as n_copies
  from (select distinct named_, u_ from drawn_) x)
select {cols}, c.n_copies::integer as n_copies, k.copy::integer as copy,
  md5('order{seed}:' || coalesce(cast(d.doc_id as varchar), md5(coalesce(d.text, ''))) || ':' || k.copy) as shuffle_key
from drawn_ d join counts_ c on d.u_ = c.u_ and d.named_ is not distinct from c.named_,
  unnest(range(1, c.n_copies + 1)) k(copy)"""
