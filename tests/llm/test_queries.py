"""The registered queries and the pipeline over the smallest tables."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from test_operators import components_by_brute_force, contaminated_by_brute_force, passage_words_by_brute_force, removed_by_brute_force, removed_passages
from tools.check import compare, connect

SF = "/root/testdata/sf0.001"
OPS = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]


@pytest.fixture(scope="module")
def documents():
    return duckdb.connect().execute(f"select doc_id, text, lang, source, n_chars from '{SF}/documents.parquet'").fetchall()


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in OPS) == list(range(1, 14))


@pytest.mark.parametrize("name", OPS)
def test_query(spark, name):
    rows, state, note = compare(spark, connect(SF), name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert state in ("ok", "rows-only"), (rows, state, note)


def test_against_brute_force(spark, documents):
    run = lambda n: sorted(tuple(r) for r in entry.queries()[n](spark, SF).collect())
    items = duckdb.connect().execute(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    passages = dict(passage_words_by_brute_force([d[:2] for d in documents], 51))
    assert run("op1_suffix_dedup") == sorted((*r, passages[r[0]]) for r in removed_by_brute_force(documents, 400))
    assert run("op6_decontaminate") == sorted(contaminated_by_brute_force([d[:2] for d in documents], items, 10))
    assert run("op10_neardup") == sorted(components_by_brute_force(documents, 85))


def test_held_out_languages(spark):
    got = entry.queries()["op5_langid"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = got.filter("held_out and lang is not null").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.98


def test_pipeline_stages(spark, documents):
    """Each stage takes effect on what the one before kept, by brute force where its rule is exact."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r[0]: r[1:] for r in duckdb.connect().execute(f"select doc_id, quality, toxic from '{SF}/labels.parquet'").fetchall()}
    got = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert out.columns == docs.columns
        got.append(out.collect())
        docs = spark.createDataFrame(got[-1], out.schema)
    ids = [{r.doc_id for r in g} for g in got]
    assert all(b <= a for a, b in zip(ids, ids[1:]))
    clean = [d for d in ids[0] if labels.get(d) == (1, 0)]
    assert sum(d in ids[1] for d in clean) >= 0.95 * len(clean)
    near = components_by_brute_force([(r.doc_id, r.text) for r in got[1]], corpus_pipeline.SIMILARITY)
    assert ids[2] == {r[0] for r in near if r[3]}
    left = removed_passages([(r.doc_id, r.text) for r in got[2]], corpus_pipeline.REPEAT_BYTES, corpus_pipeline.REPEAT_WORDS)
    for r in got[3]:
        assert left[r.doc_id] == r.text and r.n_chars == len(r.text)
    items = duckdb.connect().execute(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    hits = {r[0]: r for r in contaminated_by_brute_force([(r.doc_id, r.text) for r in got[3]], items, 10)}
    assert ids[4] == {d for d, r in hits.items() if r[2] <= 0.5 * r[1]}
    before = {r.doc_id: r.text for r in got[3]}
    assert all((r.text == before[r.doc_id]) == (hits[r.doc_id][2] == 0) for r in got[4])
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect()) == sorted(tuple(r) for r in got[5])


def test_pipeline_passages(spark, documents):
    """No passage of 51 words that repeats stays in any document, and nothing goes but such passages and repeats of REPEAT_BYTES."""
    import re

    rows = [d[:2] for d in documents]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.suffix_array_dedup(spark, docs, SF).collect()}

    def windows(text):
        data = (text or "").encode()
        at = [m.span() for m in re.finditer(rb"[^\x09-\x0d\x20]+", data)]
        return [(data[a[0]: b[1]], b[1] - a[0]) for a, b in zip(at, at[50:])]

    seen = {}
    for _, text in rows:
        for w, n in windows(text):
            seen[w] = seen.get(w, 0) + 1
    again = {w for w, k in seen.items() if k > 1}
    assert any(len(w) < corpus_pipeline.REPEAT_BYTES for w in again)
    assert not any(w in again for text in got.values() for w, _ in windows(text))
    untouched = {d for d, n, gone, *_ in removed_by_brute_force(rows, corpus_pipeline.REPEAT_BYTES) if not gone and not any(w in again for w, _ in windows(dict(rows)[d]))}
    assert all(got[d] == dict(rows)[d] for d in untouched if (dict(rows)[d] or "").strip())


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties and repeated rows, an extra column with a name the stages use themselves."""
    rng = random.Random(2)
    word = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    base = word(300)
    rows = [(1, base, "en", "src0", 1), (2, base, "en", "src0", 1), (None, base, None, None, None), (3, None, None, None, None), (None, None, "en", "src1", 0), (4, "", "en", "src1", 0), (5, " \n", "en", "src1", 2),
            (6, word(60_000), "fr", "src2", 9), (7, word(80), "de", "src3", 9), (7, word(80), "de", "src3", 9), (8, word(20), "en", None, 9), (8, word(20), "en", None, 9)]
    rows.append(rows[-1])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("own") for c in ("rid", "node", "label", "keep", "spans", "tid", "_own")}).repartition(3)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, odd, name, stage):
    out = stage(spark, odd, SF)
    rows = out.collect()
    last = stage is corpus_pipeline.STAGES[-1][1]
    assert out.columns[: len(odd.columns)] == odd.columns and (last or len(out.columns) == len(odd.columns))
    assert all(r.rid == r.label == "own" for r in rows)
    texts = {(r.doc_id, (r.text or "")[:20]) for r in rows}
    before = {(r.doc_id, (r.text or "")[:20]) for r in odd.collect()}
    if name == "near_dedup":
        assert (1, rows_text := next(t for d, t in before if d == 1)) in texts and not {(2, rows_text), (None, rows_text)} & texts
        assert sum(r.doc_id == 8 for r in rows) == 2
    if name in ("near_dedup", "suffix_array_dedup", "benchmark_decontamination"):
        assert {(3, ""), (None, ""), (4, ""), (5, " \n")} <= texts and any(r.doc_id == 6 and len(r.text) > 100_000 for r in rows)
    if name == "suffix_array_dedup":
        assert not {1, 2} & {d for d, _ in texts} and all(r.text is None for r in rows if r.doc_id == 3)
    empty = stage(spark, odd.limit(0), SF)
    assert empty.collect() == [] and empty.columns == out.columns
