"""Quality classifier by importance resampling.

Text is described by hashed n-grams: words, pairs of words, the first bytes of words,
and words, word shapes and repetitions that make up a large share of it (with the share's power of two). Generative models give the share
of documents that hold each n-gram: one for the target (labelled good and not toxic) and for each way a labelled
document fails, one over words and one over shares, all smoothed towards the rate in the whole raw corpus. A document's importance weight is its target likelihood
over that of the raw mixture of the models; n-grams whose counts do not differ significantly weigh nothing. Documents
are drawn without replacement by Gumbel top-k: log weight / temperature plus a Gumbel number hashed from the
document, of which the k largest stay; k is the number of documents that are rather target than not.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlake.llm.common import small_batches, written
from voltlake.llm.textops import LOWER, U, mixed, sequences, table, word_hashes

BUCKETS = 1 << 17  # of each kind of n-gram
KINDS = 4
SAMPLE_ROWS = 20_000  # labelled documents the models are fitted on
SMOOTH = 20.0  # documents of the raw corpus that stand behind each model
SIGNIFICANT = 7.0  # deviations
TEMPERATURE = 0.1
SEED = 29
PREFIX = (4, 5)
BURST = 5
_FINE = 1 << 12  # buckets in which shares are counted

_WORD = table(bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))
_SPACE = table(b" \t\n\r\x0b\x0c")
_UPPER = table(bytes(range(0x41, 0x5B))).astype(np.int64)
_CLASS = np.where(_SPACE, 0, np.where(_WORD, 1, 2)).astype(np.int8)


def ngrams(text: str | None, keyed: bool = False) -> tuple[np.ndarray, int]:
    """Distinct hashed n-grams of a text in order, and if ``keyed`` a 63-bit key that near copies mostly share (the smallest hash of five words)."""
    buf = np.frombuffer((text or "").encode(), dtype=np.uint8)
    kind = _CLASS[buf]
    edge = np.flatnonzero(np.diff(kind, prepend=0, append=0))
    if not len(edge):
        return np.empty(0, dtype=np.int64), 0
    starts, ends = edge[:-1], edge[1:]
    some = kind[starts] > 0
    starts, ends = starts[some], ends[some]
    words = word_hashes(buf, starts, ends)
    mask = U(BUCKETS - 1)
    low = LOWER[buf]
    parts = [words & mask, (sequences(words, 2) & mask) + U(BUCKETS)]
    for n in PREFIX:
        long = np.flatnonzero(ends - starts >= n)
        parts.append((word_hashes(low, starts[long], starts[long] + n) & mask) + U(2 * BUCKETS))
    upper, last = _UPPER[buf[starts]], _UPPER[buf[ends - 1]]
    shape = mixed(np.where(kind[starts] == 1, 1 + upper + 2 * last, words.view(np.int64)).astype(U))
    again = np.array([np.count_nonzero(words[k:] == words[:-k]) for k in (1, 2)])
    parts += [_bursts(np.bincount((words & U(_FINE - 1)).astype(np.int64)), len(words), 1), _bursts(np.bincount((sequences(shape, 2) & U(_FINE - 1)).astype(np.int64)), len(words), 2), _bursts(again, len(words), 3)]
    held = np.zeros(KINDS * BUCKETS, dtype=bool)
    for x in parts:
        held[x.astype(np.int64)] = True
    key = 0
    if keyed:
        five = sequences(words, 5)
        key = int((five if len(five) else mixed(np.array([words.sum()], dtype=U))).min() >> U(1))
    eight = np.flatnonzero(held.view(np.uint64))
    row, place = np.nonzero(held.reshape(-1, 8)[eight])
    return eight[row] * 8 + place, key


def _bursts(count: np.ndarray, total: int, kind: int) -> np.ndarray:
    """Buckets of the values that make up at least 2^-BURST of all, four at least, hashed with the power of two of their share."""
    often = np.flatnonzero((count >= 4) & (count << BURST >= total))
    level = np.floor(np.log2(count[often] / max(1, total))).astype(np.int64)
    return (mixed(often.astype(U) * U(31) + (-level).astype(U) + U(kind << 40)) & U(BUCKETS - 1)) + U((KINDS - 1) * BUCKETS)


def labelled(labels: DataFrame, sample_rows: int) -> DataFrame:
    """(doc_id, cls) of at most ``sample_rows`` labelled documents, chosen by hash: 0 target, 1 low quality, 2 toxic.

    Several labels of one document count as the worst; a null counts as good.
    """
    one = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(1))).alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    cls = F.when(F.col("t") > 0, 2).when(F.col("q") < 1, 1).otherwise(0)
    return one.select("doc_id", cls.alias("cls")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)


def _count(frame: DataFrame, classes: int) -> np.ndarray:
    """Documents that hold each n-gram, by class; the last column of a row counts the documents. Each task sends at most one row an n-gram."""
    width = KINDS * BUCKETS

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros((classes, width + 1), dtype=np.int32)
        for rows in batches:
            grams: list[list] = [[] for _ in range(classes)]
            for text, cls in zip(rows.column("text").to_pylist(), rows.column("cls").to_pylist(), strict=True):
                grams[cls].append(ngrams(text)[0])
                total[cls, width] += 1
            for c, g in enumerate(grams):
                if g:
                    total[c, :width] += np.bincount(np.concatenate(g), minlength=width)
        cls, gram = np.nonzero(total)
        n = total[cls, gram].astype(np.int64)
        for k in range(0, len(n), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[k: k + 50_000]) for x in (cls, gram, n)], ["cls", "gram", "n"])

    out = np.zeros((classes, width + 1))
    summed = frame.mapInArrow(run, "cls long, gram long, n long").groupBy("cls", "gram").agg(F.sum("n").alias("n"))
    got = summed.toArrow()  # a table of fixed size: n-gram buckets by class
    out[got["cls"].to_numpy(), got["gram"].to_numpy()] = got["n"].to_numpy()
    return out


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict | None:
    """Log ratios of each failing class to the target, by n-gram, and the classes' shares; None without labelled target documents."""
    raw = _count(docs.select("text", F.lit(0).alias("cls")), 1)[0]
    chosen = F.broadcast(labelled(labels, sample_rows))  # at most sample_rows rows
    known = docs.select("doc_id", "text").join(chosen, "doc_id")
    keyed = known.mapInArrow(_keyed, "doc_id long, text string, cls int, key long")
    known = written(keyed.dropDuplicates(["key", "cls"]), "quality-sample")  # near copies would count as evidence again and again
    own = _count(known.select("text", "cls"), 3)
    share = np.zeros(3)
    for r in docs.select("doc_id").join(chosen, "doc_id").groupBy("cls").count().collect():
        share[r["cls"]] = r["count"]
    if not own[0, -1] or not raw[-1]:
        return None
    rate = raw[:-1] / raw[-1]
    p = [(own[c, :-1] + SMOOTH * rate) / (own[c, -1] + SMOOTH) for c in range(3)]
    ratio = np.zeros((2, KINDS * BUCKETS), dtype=np.float32)
    for k, c in enumerate((1, 2)):
        n = own[c, -1]
        if n:
            away = np.abs(own[c, :-1] - n * p[0]) / np.sqrt(n * p[0] + 1)
            back = np.abs(own[0, :-1] - own[0, -1] * p[c]) / np.sqrt(own[0, -1] * p[c] + 1)
            use = ((away > SIGNIFICANT) | (back > SIGNIFICANT)) & (p[0] > 0) & (p[c] > 0)
            ratio[k, use] = np.log(p[c][use] / p[0][use])
    return {"ratio": ratio, "share": (share / share.sum()).tolist()}


def _keyed(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for rows in batches:
        keys = [ngrams(t, keyed=True)[1] for t in rows.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text"), rows.column("cls"), pa.array(keys, pa.int64())], ["doc_id", "text", "cls", "key"])


def log_weight(grams: np.ndarray, model: dict) -> float:
    """log of target over raw likelihood."""
    share = model["share"]
    cut = int(np.searchsorted(grams, (KINDS - 1) * BUCKETS))
    terms = [math.log(share[0])]
    for c in (1, 2):
        if share[c] > 0:  # words and shares are two models of a class, of equal weight
            ratio = model["ratio"][c - 1]
            terms += [math.log(share[c] / 2) + float(ratio[part].sum(dtype=np.float64)) for part in (grams[:cut], grams[cut:])]
    top = max(terms)
    return -(top + math.log(sum(math.exp(t - top) for t in terms)))


def weights(docs: DataFrame, model: dict | None, columns: tuple = ("doc_id",)) -> DataFrame:
    """``columns`` with log_weight and the posterior of the target; every document weighs the same without a model."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # a table of fixed size
    asked = docs.select(*columns, F.col("text").alias("_vl_text"))
    fields = [f for f in asked.schema.fields if f.name != "_vl_text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", log_weight double, posterior double"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = shared.value
        for rows in batches:
            w = [log_weight(ngrams(t)[0], m) if m else 0.0 for t in rows.column("_vl_text").to_pylist()]
            post = [min(1.0, math.exp(x) * m["share"][0]) if m else 1.0 for x in w]
            yield pa.RecordBatch.from_arrays(
                [rows.column(f.name) for f in fields] + [pa.array(w, pa.float64()), pa.array(post, pa.float64())], [f.name for f in fields] + ["log_weight", "posterior"])

    return asked.mapInArrow(run, schema)


def threshold(keys: DataFrame, k: int, bins: int = 1024) -> float:
    """The k-th largest key, found by counting keys in ever narrower ranges; only counts come to the driver."""
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("*")).first()
    if not n or k >= n:
        return -math.inf
    if k <= 0:
        return math.inf
    while high > low:
        step = (high - low) / bins
        if step <= abs(high) * 2.0 ** -50 or low + step == low:
            break
        at = F.least(F.floor((F.col("key") - low) / step), F.lit(bins - 1))
        counts = {r["b"]: (r["n"], r["lo"], r["hi"]) for r in keys.filter(F.col("key").between(low, high)).groupBy(at.alias("b"))
                  .agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()}
        for b in sorted(counts, reverse=True):
            if counts[b][0] >= k:
                low, high = counts[b][1:]
                break
            k -= counts[b][0]
    return low


def gumbel(seed: int):
    """A Gumbel number from a hash of the document."""
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), own)), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return -F.log(-F.log(u))


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """(doc_id, key, log_weight, score, kept) of every row; ``key`` names the text (md5).

    A null or empty text has no n-grams and weighs as the average document. Documents that tie with the k-th stay, so
    repeated rows share their fate. Without labelled target documents all stay.
    """
    small_batches(docs.sparkSession)
    plain = docs.select("doc_id", "text")
    scored = weights(plain.withColumn("_vl_key", F.md5(F.coalesce("text", F.lit("")))), fit(plain, labels, sample_rows), ("doc_id", "_vl_key"))
    keyed = written(scored.select("doc_id", F.col("_vl_key").alias("text_md5"), "log_weight", "posterior", (F.col("log_weight") / temperature + gumbel(seed)).alias("key")), "quality")
    cut = threshold(keyed, keyed.filter("posterior >= 0.5").count())
    return keyed.select("doc_id", "text_md5", "log_weight", F.col("posterior").alias("score"), (F.col("key") >= cut).alias("kept"))


def accepted(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay."""
    good = classify(docs, labels, **options).filter("kept").select(F.col("doc_id").alias("_vl_id"), F.col("text_md5").alias("_vl_md5")).distinct()
    same = docs["doc_id"].eqNullSafe(F.col("_vl_id")) & (F.md5(F.coalesce(docs["text"], F.lit(""))) == F.col("_vl_md5"))
    return docs.join(good, same, "left_semi")
