"""Knowledge index and search."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voltlake.functions.scalars import r6, ratio

TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


BLOCK = 4096  # document ids in a block of postings
POSTING = "struct<id:bigint,tf:bigint>"


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), TOKEN_SPLIT), lambda w: w != "")


def term_counts(docs: DataFrame, doc_id: str, text: str, terms: list[str] | None = None) -> DataFrame:
    """Count of each term (or of the given ones) per document, reduced before the shuffle."""
    words = docs.select(doc_id, F.explode(F.split(F.lower(text), TOKEN_SPLIT)).alias("term")).where("term <> ''")
    if terms is not None:
        words = words.where(F.col("term").isin(terms))
    return words.groupBy("term", doc_id).agg(F.count("*").alias("tf"))


def document_counts(tf: DataFrame) -> DataFrame:
    """Documents per term. It reads ``tf`` as a whole, so that one query computes the counts once and reuses them."""
    return tf.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))


def postings(docs: DataFrame, doc_id: str, text: str, block: int = BLOCK) -> DataFrame:
    """(term, block, n, first, gaps, tfs, max_tf): postings of ``block`` neighbouring document ids in one row, ids as distances from the first.

    A row holds at most ``block`` ids, so a term of all documents is many rows; a null id has a block of its own.
    """
    if block > 1 << 15:
        raise ValueError("distances are kept in 16 bits")
    place = F.coalesce(F.pmod("_id", F.lit(block).cast("long")), F.lit(0).cast("long"))
    tf = term_counts(docs, doc_id, text).withColumnRenamed(doc_id, "_id").select("term", F.floor((F.col("_id") - place) / block).alias("block"), "_id", "tf")
    # counts, not lists, are dealt into ranges, so that every list is made once, in the task that writes it; a place in the block and its count are one number, as numbers sort fast
    rows = tf.repartitionByRange("term", "block").groupBy("term", "block").agg(
        F.sort_array(F.collect_list(F.shiftleft(place, 48).bitwiseOR(F.col("tf")))).alias("p"), F.min("_id").alias("first"), F.max("tf").alias("max_tf"))
    at = F.shiftright(F.col("p")[0], 48)
    return rows.select("term", "block", F.size("p").alias("n"), "first", F.transform("p", lambda x: (F.shiftright(x, 48) - at).cast("smallint")).alias("gaps"),
                       F.transform("p", lambda x: x.bitwiseAND(F.lit((1 << 48) - 1))).alias("tfs"), "max_tf")


def write_postings(docs: DataFrame, doc_id: str, text: str, path: str, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Postings in the order of their terms, so that a search reads few row groups, and the lexicon (term, df), one row a term."""
    spark = docs.sparkSession
    postings(docs, doc_id, text, block).sortWithinPartitions("term", "block").write.parquet(f"{path}/postings")
    blocks = spark.read.parquet(f"{path}/postings")
    blocks.groupBy("term").agg(F.sum("n").alias("df")).write.parquet(f"{path}/lexicon")
    return blocks, spark.read.parquet(f"{path}/lexicon")


def unpacked(blocks: DataFrame, *more: str) -> DataFrame:
    """(term, more, id, tf) of every posting."""
    return blocks.select("term", *more, "first", F.explode(F.arrays_zip("gaps", "tfs")).alias("_p")).select(
        "term", *more, (F.col("first") + F.col("_p.gaps")).alias("id"), F.col("_p.tfs").alias("tf"))


def index_rows(docs: DataFrame, doc_id: str, text: str, path: str) -> DataFrame:
    """Inverted index: term, document and count, with the number of documents per term.

    Counts are joined to blocks, not to postings, and both sides are written tables, so that the blocks of a frequent term can be dealt to several tasks.
    """
    blocks, lexicon = write_postings(docs, doc_id, text, path)
    return unpacked(blocks.join(lexicon, "term"), "df").withColumnRenamed("id", doc_id)


def search_postings(blocks: DataFrame, lexicon: DataFrame, query: str, n_docs: int, top_k: int = 5, sure: int = 64) -> DataFrame:
    """(id, score): the same best documents as ``search``, from postings; blocks that cannot hold one of them are not unpacked.

    A document scores at most the sum over the words of the query of its block's largest count x weight. The ``sure`` blocks of highest bound are scored first; their k-th
    best score is what the bound of any other block has to reach.
    """
    spark = blocks.sparkSession
    terms = list(spark.range(1).select(F.array_distinct(tokens(F.lit(query)))).first()[0])
    weight = F.log(F.lit(1.0) + F.lit(float(n_docs)) / F.col("df"))
    known = lexicon.where(F.col("term").isin(terms)).select("term", weight.alias("weight"))  # one row a word of the query
    hit = blocks.where(F.col("term").isin(terms)).join(F.broadcast(known), "term")
    bounds = hit.groupBy("block").agg(F.sum(F.col("max_tf") * F.col("weight")).alias("bound"))

    def scored(some: DataFrame) -> DataFrame:
        held = hit.join(some.select(F.col("block").alias("_b")), F.col("block").eqNullSafe(F.col("_b")), "left_semi")
        return unpacked(held, "weight").groupBy("id").agg(r6(F.sum(F.col("tf") * F.col("weight"))).alias("score"))

    first = scored(bounds.orderBy(F.desc("bound"), "block").limit(sure)).orderBy(F.desc("score"), "id").limit(top_k).collect()  # top_k rows
    least = first[-1]["score"] if len(first) == top_k else float("-inf")
    return scored(bounds.where(F.col("bound") >= F.lit(least - 1e-6))).orderBy(F.desc("score"), "id").limit(top_k)


def search(docs: DataFrame, doc_id: str, text: str, query: str, top_k: int = 5) -> DataFrame:
    """Best documents by summed tf x ln(1 + N/df), ties by id.

    Only words of the query leave the scan. The table of document counts has one row per word of the query, so it is
    broadcast; each task keeps its best ``top_k`` documents.
    """
    terms = list(docs.sparkSession.range(1).select(F.array_distinct(tokens(F.lit(query)))).first()[0])  # split as the documents are
    tf = term_counts(docs, doc_id, text, terms)
    n = docs.count()  # from the footers of the files
    weight = F.log(F.lit(1.0) + F.lit(float(n)) / F.col("df"))
    hits = tf.join(F.broadcast(document_counts(tf)), "term")
    return hits.groupBy(doc_id).agg(r6(F.sum(F.col("tf") * weight)).alias("score")).orderBy(F.desc("score"), doc_id).limit(top_k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def nearest(vectors: DataFrame, vec_id: str, vector: str, query: list[float], top_k: int = 5) -> DataFrame:
    """Most similar unit vectors to one query vector."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(vec_id, F.round(dot(F.col(vector), q), 5).alias("score")).orderBy(F.desc("score"), vec_id).limit(top_k)


def relevance(vectors: DataFrame, vec_id: str, vector: str, label: str, k: int, block: int = 256) -> DataFrame:
    """Precision and nDCG at k of a search with each label's mean vector; rows of the same label are relevant.

    The label means are searched in blocks of about ``block`` labels: a row meets each block once and scores against it in place, and the rank
    filter keeps k rows per label on the map side.
    """
    cells = vectors.select(label, F.posexplode(vector).alias("pos", "x"))
    mean = cells.groupBy(label, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    means = mean.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("c"))
    blocks = -(-max(1, vectors.select(label).distinct().count()) // block)
    table = means.groupBy(F.pmod(F.xxhash64(label), F.lit(blocks)).cast("int").alias("_b")).agg(F.collect_list(F.struct(F.col(label).alias("q"), "c")).alias("_all"))
    rows = vectors.select(vec_id, label, vector, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b"))
    sims = rows.join(table, "_b").select(vec_id, label, vector, F.inline("_all")).select(
        "q", vec_id, F.col(label).eqNullSafe(F.col("q")).cast("int").alias("rel"), dot(F.col(vector), F.col("c")).alias("s"))
    w = W.partitionBy("q").orderBy(F.desc("s"), vec_id)
    top = sims.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    ideal = sum(1.0 / math.log2(i + 1) for i in range(1, k + 1))
    return top.groupBy(F.col("q").alias("label")).agg(
        r6(F.avg("rel")).alias("precision_at_k"), r6(F.sum(F.col("rel") / F.log2(F.col("r") + 1)) / F.lit(ideal)).alias("ndcg_at_k"))


def learning_entries(df: DataFrame, agent: Column, decision: Column, outcome: Column, lesson: Column, at: Column) -> DataFrame:
    e = df.select(agent.alias("agent"), decision.alias("decision"), outcome.alias("outcome"), lesson.alias("lesson"), at.alias("recorded_at"))
    return e.withColumn("entry_id", F.sha2(F.concat_ws("|", "agent", "decision", "outcome", "recorded_at"), 256))


def index_freshness(source: DataFrame, indexed: DataFrame, key: str, ts: str) -> DataFrame:
    """Share of the source in the index, and hours by which the index lags."""
    flag = source.select(key, ts).join(indexed.select(key).withColumn("_i", F.lit(1)), key, "left")
    lag = (F.unix_micros(F.max(ts).cast("timestamp")) - F.unix_micros(F.max(F.when(F.col("_i") == 1, F.col(ts))).cast("timestamp"))) / F.lit(3.6e9)
    share = ratio(F.count("_i"), F.count("*"))
    return flag.agg(F.count("*").alias("documents"), F.count("_i").alias("indexed"), r6(share).alias("coverage"), r6(lag).alias("lag_hours"),
                    ((share >= 0.95) & (lag <= 24)).alias("met"))


def gaps(searches: DataFrame, query: str, answered: DataFrame) -> DataFrame:
    """Searches without a good answer, by frequency. Repeats are counted before the join."""
    counted = searches.groupBy(query).agg(F.count("*").alias("searches"))
    return counted.join(answered.select(query).distinct(), query, "left_anti")
