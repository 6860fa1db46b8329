"""Document fingerprints by I-Match with several randomised lexicon subsets, in DataFrame functions only.

Terms are runs of letters and digits in lower case, known by a 64-bit hash. A term's document frequency is counted over
all documents; terms whose inverse document frequency lies in the band are the lexicon, a table. The terms of a text are
exploded and looked up in it. As each of its terms is in one of e^(upper bound) documents at least, the lexicon has at most e^(upper bound) times the
mean number of distinct terms of a document, whatever the size of the corpus. The lexicon is split at random into SLOTS subsets, thinned to
one term in 2^level; a subset's value is the hash of its sorted distinct terms. The level follows the number of terms of the text, and a
fingerprint holds the values at that level and the next thinner one, so that texts of like size can be compared at a level they share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltlake.llm.common import tasks, written

SLOTS = 32
IDF_BAND = (1.6, 9.2)
BROADCAST = 4_000_000  # terms; a larger lexicon is joined as Spark chooses


def term_words(text: Column) -> Column:
    """Distinct terms of a text, among them perhaps the empty string."""
    return F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))


def term_hashes(text: Column) -> Column:
    """Distinct 64-bit hashes of the terms of a text."""
    return F.array_distinct(F.transform(F.filter(term_words(text), lambda w: w != ""), lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, low: float, high: float) -> DataFrame:
    """The terms that occur in two documents at least and whose inverse document frequency is inside the band, as a written table."""
    hit = docs.select(F.explode(term_words(F.col("text"))).alias("word")).where("word <> ''").select(F.xxhash64("word").alias("term"))
    freq = hit.groupBy("term").agg(F.count("*").alias("df"))
    total = docs.agg(F.count("*").alias("n")).scalar()
    terms = written(freq.filter((F.col("df") >= 2) & F.ln(total / F.col("df")).between(low, high)).select("term"), "lexicon")
    return F.broadcast(terms) if terms.count() <= BROADCAST else terms


def _thin(terms: Column, level: Column) -> Column:
    return F.filter(terms, lambda h: F.shiftrightunsigned(h, 40).bitwiseAND(F.call_function("shiftleft", F.lit(1), level).cast("long") - 1) == 0)


def _values(terms: Column) -> Column:
    """The hash of the sorted terms of every slot, joined by commas, in one pass: the slot is the top bits of the term, so a slot's terms are neighbours."""
    bits = SLOTS.bit_length() - 1
    slot = lambda h: F.shiftrightunsigned(h.bitwiseXOR(F.lit(-(1 << 63))), 64 - bits).cast("int")
    done = lambda a: F.when(a["slot"] < 0, "").otherwise(F.substring(F.lpad(F.hex(a["value"]), 16, "0"), 1, 8))
    commas = lambda a, to: F.repeat(F.lit(","), to - F.greatest(a["slot"], F.lit(0)))
    make = lambda s, v, o: F.struct(s.alias("slot"), v.alias("value"), o.alias("out"))

    def step(a: Column, h: Column) -> Column:
        same = a["slot"] == slot(h)
        return make(slot(h), F.xxhash64(F.when(same, a["value"]).otherwise(F.lit(0).cast("long")), h), F.when(same, a["out"]).otherwise(F.concat(a["out"], done(a), commas(a, slot(h)))))

    start = make(F.lit(-1), F.lit(0).cast("long"), F.lit(""))
    return F.aggregate(terms, start, step, lambda a: F.concat(a["out"], done(a), commas(a, F.lit(SLOTS - 1))))


def with_fingerprint(df: DataFrame, text: str, out: str, terms: DataFrame) -> DataFrame:
    """The rows of ``df``, one a ``key``, with column ``out``: ``level:values/values of the next level``, or ``x:hash`` for a text without a term of the lexicon.

    Rows of one key are equal. The first exploded term of a text carries its row, so that one aggregation brings row and terms together.
    """
    names = [c for c in df.columns if c != "key"]
    # the array is a column of its own, so that exploding it is compiled and does not copy the text for every term
    each = df.withColumn("_terms", term_words(F.col(text))).select("*", F.posexplode_outer("_terms").alias("_at", "_word"))
    each = each.select("key", F.when(F.col("_word") != "", F.xxhash64("_word")).alias("term"), F.when(F.coalesce("_at", F.lit(0)) == 0, F.struct(*names)).alias("_row"))
    found = each.join(terms.withColumnRenamed("term", "_known"), F.col("term") == F.col("_known"), "left").filter("_row is not null or _known is not null")
    df = found.groupBy("key").agg(F.first("_row", ignorenulls=True).alias("_row"), F.array_sort(F.array_distinct(F.collect_list("_known"))).alias("_band")).select("key", "_row.*", "_band")
    df = df.withColumn("_level", F.greatest(F.lit(0), F.ceil(F.log2(F.size("_band") / F.lit(float(SLOTS))))).cast("int"))
    df = df.withColumn("_thin", _thin(F.col("_band"), F.col("_level")))
    made = F.concat(F.col("_level").cast("string"), F.lit(":"), _values(F.col("_thin")), F.lit("/"), _values(_thin(F.col("_thin"), F.col("_level") + 1)))
    bare = F.concat(F.lit("x:"), F.md5(F.array_join(F.array_sort(term_hashes(F.col(text))).cast("array<string>"), ",")))
    return df.withColumn(out, F.when(F.size("_band") == 0, bare).otherwise(made)).drop("_band", "_level", "_thin")


def likeness(a: str, b: str) -> Column:
    """Share of equal values among those set in either fingerprint, at the level both have; 1 for equal fingerprints, 0 without such a level."""
    pa, pb = F.split(F.col(a), "[:/]"), F.split(F.col(b), "[:/]")
    la, lb = F.expr("try_cast(split(`%s`, ':')[0] as int)" % a), F.expr("try_cast(split(`%s`, ':')[0] as int)" % b)
    values = lambda p, k: F.split(F.get(p, k), ",")
    va = F.when(lb == la + 1, values(pa, F.lit(2))).otherwise(values(pa, F.lit(1)))
    vb = F.when(la == lb + 1, values(pb, F.lit(2))).otherwise(values(pb, F.lit(1)))
    pairs = F.arrays_zip(va.alias("u"), vb.alias("v"))
    same = F.size(F.filter(pairs, lambda p: (p["u"] == p["v"]) & (p["u"] != "")))
    either = F.size(F.filter(pairs, lambda p: (p["u"] != "") | (p["v"] != "")))
    shared = F.abs(la - lb) <= 1
    return F.when(F.col(a) == F.col(b), 1.0).when(shared & (either > 0), same / either).otherwise(0.0).cast("double")


def _never_null(key: Column) -> Column:
    """A key that Spark knows to have no nulls, so that no join adds a filter of its own to a shuffle that it could share."""
    return F.coalesce(key, F.lit(bytearray()))


def row_key() -> Column:
    """One key for id and text, never null, so that joins and the shuffle before them agree on the partitioning."""
    return _never_null(F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.md5("text"))))).alias("key")


def next_keys(keys: DataFrame) -> DataFrame:
    """(doc_id, key, n, copies, nx) of distinct rows (doc_id, key, n, copies): the key of the next row by ascending doc_id, nulls last, and of the first after the last.

    The ids are cut into as many ranges as there are shuffle partitions; each is ordered alone, and the first row of
    every range, one row a range, closes the gaps between them.
    """
    ranges = max(2, tasks(keys.sparkSession))
    cuts = sorted(set(keys.filter("doc_id is not null").approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 1.0 / (4 * ranges))))
    place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("doc_id"))) if cuts else F.lit(0)
    binned = keys.withColumn("bin", F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(place))
    inner = Window.partitionBy("bin").orderBy(F.col("doc_id").asc_nulls_last(), F.col("key"))
    led = binned.withColumn("nx", F.lead("key").over(inner))
    heads = binned.groupBy("bin").agg(F.min(F.struct("doc_id", "key"))["key"].alias("head"))
    across = Window.orderBy("bin")
    heads = heads.select("bin", F.coalesce(F.lead("head").over(across), F.first("head").over(across)).alias("after"))
    return led.join(F.broadcast(heads), "bin").select("doc_id", "key", "n", "copies", F.coalesce("nx", "after").alias("nx"))  # at most one row a range


def fingerprints(docs: DataFrame, idf_band=IDF_BAND) -> DataFrame:
    """doc_id, n_chars, fingerprint, edited_sha256, edited_fingerprint, near_edited and near_next of every row.

    A null text is empty. Rows with equal id and text take one place in the order and each get its result. Rows of one
    id with different texts follow each other by a hash of the text; a null id comes last. A lone document is followed
    by itself. Other columns are ignored.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = tasks(docs.sparkSession)
    terms = lexicon(docs, *idf_band)
    # all below read this one shuffle of the texts, and the lookups need no other
    texts = docs.select(row_key(), "text").repartition(n, "key")
    # Spark does not know this key for that of the shuffle, so fingerprints, without texts, are dealt once more: they are made once and not by each of their readers
    own = with_fingerprint(texts, "text", "fingerprint", terms).select(_never_null(F.unhex(F.hex("key"))).alias("key"), "fingerprint")
    texts = texts.dropDuplicates(["key"])
    keys = docs.select("doc_id", row_key(), F.char_length("text").alias("n")).groupBy("doc_id", "key").agg(F.max("n").alias("n"), F.count("*").alias("copies"))
    order = next_keys(keys).withColumnRenamed("key", "before")
    tails = (
        texts.join(order, texts["key"] == order["nx"]).join(own.alias("after"), F.col("nx") == F.col("after.key"))
        .select("before", "doc_id", "n", "copies", F.col("after.fingerprint").alias("nx_fingerprint"), F.substring("text", F.lit(1), F.floor(F.col("n") / 4).cast("int")).alias("tail")))
    both = texts.join(tails, texts["key"] == tails["before"]).join(own, "key")
    edited = both.select(
        "key", "doc_id", "copies", F.col("n").cast("long").alias("n_chars"), "fingerprint", "nx_fingerprint",
        F.concat(F.substring("text", F.lit(1), (F.col("n") - F.floor(F.col("n") / 4)).cast("int")), "tail").alias("edited"))
    out = with_fingerprint(edited, "edited", "edited_fingerprint", terms)
    out = out.withColumn("_copy", F.explode(F.expr("array_repeat(0, cast(copies as int))")))
    return out.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "nx_fingerprint").alias("near_next"))
