"""Language identification by multilingual mixture inference.

Each language has a distribution over hashed byte trigrams, counted over all labelled documents that are not held out. A
document's trigrams are drawn from a mixture of languages; expectation-maximisation estimates the proportions, and
the set of languages is the one of highest likelihood less a penalty for every further language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltlake.llm.common import small_batches
from voltlake.llm.textops import LOWER, table

BUCKETS = 1 << 15
SMOOTH = 0.5
ROUNDS = 12
PENALTY = 0.5  # of the log number of trigrams, for each further language
FOLDS, HELD_OUT = 3, 1

_INSIDE = table(bytes([*range(0x61, 0x7B), *range(0x80, 0x100)]))


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of the letters of a text (all else is one separator), with their numbers."""
    b = LOWER[np.frombuffer((" " + (text or "") + " ").encode(), dtype=np.uint8)]
    inside = _INSIDE[b]
    b = np.where(inside, b, 32)[np.append(True, inside[1:] | inside[:-1])].astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, dtype=np.int64), np.empty(0)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    at = ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)
    n = np.bincount(at, minlength=BUCKETS)
    some = np.flatnonzero(n)
    return some, n[some].astype(np.float64)


def held_out() -> Column:
    """Is the document in the fold that is never learned from? A null id is not."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def fit(docs: DataFrame) -> dict | None:
    """Log probability of every bucket by language. What comes to the driver has a fixed size for each language."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("text", "lang")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total: dict[str, np.ndarray] = {}
        for rows in batches:
            for text, lang in zip(rows.column("text").to_pylist(), rows.column("lang").to_pylist(), strict=True):
                at, n = trigrams(text)
                total.setdefault(lang, np.zeros(BUCKETS))[at] += n
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at].astype(np.int64))], ["lang", "bucket", "n"])

    counts: dict[str, np.ndarray] = {}
    got = known.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    for lang, at, n in zip(got["lang"].to_pylist(), got["bucket"].to_pylist(), got["n"].to_pylist(), strict=True):
        counts.setdefault(lang, np.zeros(BUCKETS))[at] = n
    if not counts:
        return None
    names = sorted(counts)
    n = np.stack([counts[x] for x in names], axis=1) + SMOOTH
    return {"names": names, "p": (n / n.sum(axis=0)).astype(np.float64)}


def mixture(p: np.ndarray, n: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Proportions of the languages (columns of p) of highest likelihood, and its logarithm."""
    share, size = np.full(p.shape[1], 1.0 / p.shape[1]), n.sum()
    for _ in range(rounds):
        new = share * ((n / (p @ share)) @ p) / size
        done = np.abs(new - share).max() < 1e-3
        share = new
        if done:
            break
    return share, float(n @ np.log(p @ share))


def infer(text: str | None, model: dict, rounds: int = ROUNDS, penalty: float = PENALTY) -> dict[str, float]:
    """Proportions of the selected languages; empty for a text without letters."""
    if not text or not any(map(str.isalpha, text)):
        return {}
    at, n = trigrams(text)
    names = model["names"]
    if not len(at):
        return {names[0]: 1.0}
    p = model["p"][at]
    share, _ = mixture(p, n, rounds)
    order = np.argsort(-share, kind="stable")
    cost = penalty * np.log(n.sum() + 1)
    best, best_share = float(n @ np.log(p[:, order[0]])), np.ones(1)
    for k in range(2, len(names) + 1):
        own, value = mixture(p[:, order[:k]], n, rounds)
        if value - cost * (k - 1) <= best:
            break
        best, best_share = value - cost * (k - 1), own
    return {names[i]: float(s) for i, s in zip(order, best_share, strict=False)}


def identify(docs: DataFrame, rounds: int = ROUNDS, penalty: float = PENALTY) -> DataFrame:
    """doc_id, held_out, lang_pred, score and proportions of every row.

    ``und`` with score 0 for a null text, one without a letter, or when nothing was learned. Of equal shares the
    language that sorts first wins. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))  # of fixed size for each language

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = shared.value
        for rows in batches:
            found = [infer(t, model, rounds, penalty) if model else {} for t in rows.column("text").to_pylist()]
            top = [max(sorted(f), key=f.get) if f else "und" for f in found]
            yield pa.RecordBatch.from_arrays([
                rows.column("doc_id"), rows.column("held_out"), pa.array(top, pa.string()), pa.array([f.get(t, 0.0) for f, t in zip(found, top, strict=True)], pa.float64()),
                pa.array([list(f.items()) for f in found], pa.map_(pa.string(), pa.float64()))], ["doc_id", "held_out", "lang_pred", "score", "proportions"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double, proportions map<string,double>")
