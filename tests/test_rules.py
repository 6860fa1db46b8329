"""Truth tables of the fixed rules and properties of the statistics."""

import itertools

import pytest
from pyspark.sql import functions as F

from voltlake.operators import catalog, cost, customers, drift, experiments, forecast, governance, metrics, models, ops, privacy, quality, windows
from voltlake.operators.cleanse import dedup_latest, email_valid, standard_date
from voltlake.sources import files, kv


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("d,m,c", list(itertools.product(["none", "medium", "high"], ["none", "medium", "high"], [False, True])))
def test_drift_action(spark, d, m, c):
    sev = "high" if c else "none"
    want = ("emergency_retrain" if c else "trigger_retrain") if "high" in (d, m, sev) else "schedule_review" if "medium" in (d, m) else "monitor"
    act = drift.action(F.lit(d), F.lit(m), F.lit(sev), F.lit(c))
    assert one(spark, act) == want
    assert one(spark, drift.alert(act)) == {"emergency_retrain": "P1", "trigger_retrain": "P2"}.get(want, "P3")


@pytest.mark.parametrize("name,rec,want,conf", [
    ("DataQualityError", False, "fallback", 0.80), ("ValidationError", True, "escalate", 1.0), ("ResourceExhausted", False, "scale_up", 0.95), ("OutOfMemoryError", True, "scale_up", 0.95),
    ("ReadTimeout", False, "retry_with_backoff", 0.90), ("SchemaMismatch", False, "retry", 0.75), ("SchemaEvolution", False, "retry", 0.75), ("SchemaEvolutionTimeout", False, "retry_with_backoff", 0.90),
    ("ModelNotFound", False, "fallback", 0.85), ("DeploymentFailed", False, "rollback", 0.98), ("BudgetExceeded", False, "skip", 1.0), ("CostCeiling", False, "skip", 1.0), ("Strange", False, "diagnose", None)])
def test_error_rules(spark, name, rec, want, conf):
    s, c = ops.classify_error(F.lit(name), F.lit(rec))
    assert (one(spark, s), one(spark, c)) == (want, conf)


@pytest.mark.parametrize("spend,est,want", [
    (150.0, 1.0, "Daily budget exceeded"), (149.99, 0.01, "OK"), (10.0, 50.0, "OK"), (10.0, 50.01, "Task cost ceiling exceeded: £50.01"),
    (120.0, 40.0, "Task would exceed daily budget: £120.00 + £40.00 > £150.00"), (160.0, 60.0, "Daily budget exceeded")])
def test_cost_gate(spark, spend, est, want):
    assert one(spark, cost.gate(F.lit(spend), F.lit(est))) == want


@pytest.mark.parametrize("pct,want", [(80.0, "ok"), (80.1, "P3_warn"), (90.0, "P3_warn"), (90.1, "P2_pause"), (99.9, "P2_pause"), (100.0, "P1_halt")])
def test_budget_levels(spark, pct, want):
    assert one(spark, cost.level(F.lit(pct))) == want


@pytest.mark.parametrize("kind,days,ok", [("customer_data", 2555, True), ("customer_data", 2556, False), ("temp_data", 90, True), ("temp_data", 91, False), ("unknown", 365, True), ("unknown", 366, False)])
def test_retention(spark, kind, days, ok):
    assert one(spark, governance.retention_ok(F.lit(kind), F.lit(days))) is ok


@pytest.mark.parametrize("just,c,n,want", [
    (None, 60.0, 9, "Missing business justification"), ("x", 50.5, 9, "Estimated cost 50.5 exceeds limit of £50"), ("x", 50.0, 5, "Maximum concurrent tasks (5) reached"), ("x", 50.0, 4, "All validations passed")])
def test_request_gate(spark, just, c, n, want):
    assert one(spark, ops.request_gate(F.lit(just).cast("string"), F.lit(c), F.lit(n))) == want


@pytest.mark.parametrize("text,task,target", [
    ("Reduce churn by 20% please", "daily_churn_pipeline", 20), ("reduce churn", "daily_churn_pipeline", None), ("forecast demand", "forecast_load", None), ("Optimize tariff", "optimize_pricing", None),
    ("detect fraud", "detect_fraud", None), ("predict acquisition", "train_acquisition", None), ("segment customers", "customer_segmentation", None), ("model risk", "model_portfolio_risk", None), ("hello", None, None)])
def test_triage(spark, text, task, target):
    r = ops.triage(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert (r["task"], r["target_value"], r["state"]) == (task, target, "accepted" if task else "clarification_needed")


PII = [("audit", "email", "a.b@example.com", 1), ("audit", "phone", "+441234567890", 1), ("audit", "postcode", "SW1A 1AA", 1), ("audit", "ni_number", "AB123456C", 1), ("catalog", "email", "x@y.org", 1),
       ("catalog", "phone", "020 7946 0958", 1), ("catalog", "postcode", "M1 1AE", 1), ("catalog", "account_number", "ACC12345678", 1), ("catalog", "mpan", "1234567890123", 1), ("audit", "email", "nobody", 0)]


@pytest.mark.parametrize("which,kind,text,n", PII)
def test_pii_patterns(spark, which, kind, text, n):
    pats = privacy.AUDIT_PATTERNS if which == "audit" else privacy.CATALOG_PATTERNS
    got = {r["type"]: r["count"] for r in privacy.scan_values(spark.createDataFrame([(text,)], "t string"), ["t"], pats).collect()}
    assert got[kind] == n


@pytest.mark.parametrize("text,hit", [("mail a@b.co now", True), ("call 555-123-4567", True), ("id 123-45-6789", True), ("plain", False)])
def test_row_guard(spark, text, hit):
    assert one(spark, privacy.has_pii(F.lit(text))) is hit


def test_mask_and_names(spark):
    assert one(spark, privacy.mask(F.lit("to a@b.com at SW1A 1AA"))) == "to [EMAIL] at [POSTCODE]"
    assert one(spark, privacy.name_is_pii(F.lit("Email_Hash"))) is True
    assert one(spark, privacy.name_is_pii(F.lit("amount"))) is False


def test_cleansing(spark):
    dates = spark.createDataFrame([("2024-02-30",), ("01/02/2024",), ("20240301",), (None,)], "t string").select(standard_date("t").alias("d")).collect()
    assert [str(r["d"]) for r in dates] == ["None", "2024-02-01", "2024-03-01", "None"]
    ok = spark.createDataFrame([("a@b.com",), ("a@b",), ("",)], "e string").select(email_valid("e").alias("v")).collect()
    assert [r["v"] for r in ok] == [True, False, False]
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, v int, x string")
    once = dedup_latest(df, ["k"], ["v"])
    assert sorted(map(tuple, once.collect())) == [(1, 2, "b"), (2, 1, "c")] == sorted(map(tuple, dedup_latest(once, ["k"], ["v"]).collect()))


def test_quality_suite(spark):
    df = spark.createDataFrame([("1", 20, "a@b.com"), ("1", 17, "bad"), (None, None, None)], "customer_id string, age int, email string")
    got = {r["expectation"]: (r["evaluated"], r["unexpected"], r["success"]) for r in quality.validate(df, quality.suite_for("Customer")).collect()}
    assert got == {"not_null": (3, 1, False), "unique": (2, 2, False), "between": (3, 1, False), "regex": (3, 1, False)}
    assert [e.kind for e in quality.suite_for("usage")] == ["row_count"]
    s = quality.statistics(quality.validate(df, quality.suite_for("usage"))).first()
    assert (s["evaluated_expectations"], s["success"], s["success_percent"]) == (1, True, 100.0)


def test_auc(spark):
    df = spark.createDataFrame([(i, (i * 7 % 11) / 10, i % 2) for i in range(40)], "id int, s double, y int")
    a = metrics.auc(df, "s", "y").first()["auc"]
    b = metrics.auc(df.withColumn("s", 1 - F.col("s")), "s", "y").first()["auc"]
    assert 0 <= a <= 1 and a + b == pytest.approx(1.0, abs=2e-6)
    assert metrics.auc(df.where("y = 1"), "s", "y").first()["auc"] is None
    assert metrics.auc(spark.createDataFrame([(0.9, 1), (0.1, 0)], "s double, y int"), "s", "y").first()["auc"] == 1.0


def test_equal_samples_show_no_drift(spark):
    df = spark.createDataFrame([(float(i % 50), c) for i in range(500) for c in (0, 1)], "x double, c int")
    assert drift.psi(df, ["x"], F.col("c") == 1).first()["psi"] == 0.0
    assert drift.ks(df, ["x"], F.col("c") == 1).first()["ks"] == 0.0
    moved = df.withColumn("x", F.when(F.col("c") == 1, F.col("x") + 100).otherwise(F.col("x")))
    p, k = drift.psi(moved, ["x"], F.col("c") == 1).first(), drift.ks(moved, ["x"], F.col("c") == 1).first()
    assert p["psi"] > 0.2 and p["drift"] and k["ks"] == 1.0 and k["p_value"] == 0.0


def test_scd2_intervals_are_disjoint(spark):
    h = spark.sql("select id % 3 as k, id as seq, cast((id * 5) % 4 as string) as st, timestamp_ntz'2024-01-01' + make_dt_interval(id) as ts from range(60)")
    rows = windows.scd2(h, "k", ["st"], "ts", "seq").orderBy("k", "valid_from").collect()
    for a, b in zip(rows, rows[1:]):
        if a["k"] == b["k"]:
            assert a["valid_to"] == b["valid_from"] and a["st"] != b["st"] and not a["is_current"]
        else:
            assert a["is_current"]


def test_last_n_none_keeps_all(spark):
    df = spark.range(10).select((F.col("id") % 2).alias("k"), "id")
    assert windows.last_n(df, "k", "id", None).count() == windows.last_n(df, "k", "id", 0).count() == 10
    assert windows.last_n(df, "k", "id", 2).count() == 4


def test_lineage_cycle_ends(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "b")], "source string, target string")
    got = {(r["node"], r["depth"]) for r in catalog.reach(e, spark.createDataFrame([("a",)], "id string")).collect()}
    assert got == {("b", 1), ("c", 2)}
    up = {r["node"] for r in catalog.reach(e, spark.createDataFrame([("c",)], "id string"), upstream=True).collect()}
    assert up == {"b", "a"}


def test_kv(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, x string, y int")
    ch = spark.createDataFrame([(1, None, True, None, False), (3, "n", True, 7, True)], "k int, x string, x_set boolean, y int, y_set boolean")
    assert sorted(map(tuple, kv.update(base, ch, ["k"], ["x", "y"]).collect())) == [(1, None, 1), (2, "b", 2), (3, "n", 7)]
    items = spark.createDataFrame([(1, "z", None, 5), (1, "w", 4, 3)], "k int, x string, y int, v int")
    assert sorted(map(tuple, kv.put(base, items, ["k"], "v").collect())) == [(1, "z", None), (2, "b", 2)]


def test_incremental_takes_unlanded_ties(spark):
    src = spark.createDataFrame([(1, 10), (2, 20), (3, 20), (4, 30)], "id int, t int")
    got = {r["id"] for r in files.incremental(src, src.where("id <= 2"), "t", "id").collect()}
    assert got == {3, 4}
    assert files.incremental(src, src.where("false"), "t", "id").count() == 4


def test_schema_gate(spark, tmp_path):
    df = spark.createDataFrame([(1, "20240101")], "a int, ds string")
    with pytest.raises(ValueError):
        files.gated_write(df, spark.createDataFrame([], "a long, ds string").schema, str(tmp_path / "t"))
    files.gated_write(df, df.schema, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1


def test_landing_counts_only_the_new_batch(spark, tmp_path):
    import time

    df = spark.sql("select id, date'2024-01-01' as d from range(5)")
    assert files.land(df, str(tmp_path / "b"), "d")["records_ingested"] == 5
    time.sleep(1.1)
    r = files.land(df.limit(2).withColumn("d", F.lit("2024-01-02").cast("date")), str(tmp_path / "b"), "d")
    assert r["records_ingested"] == 2 and r["bytes_written"] > 0
    assert spark.read.parquet(str(tmp_path / "b")).count() == 7


def test_usage_drop_is_found(spark):
    from voltlake.operators.anomaly import usage_anomalies

    df = spark.createDataFrame([(1, 100.0 + i % 5) for i in range(20)] + [(1, 1.0)], "k int, v double")
    r = usage_anomalies(df, ["k"], "v").collect()
    assert [x["type"] for x in r] == ["drop"]


def test_experiment_maths(spark):
    assert one(spark, experiments.sample_size(F.lit(0.5), 0.05)) == 1570
    units = spark.createDataFrame([(0, 0)] * 900 + [(0, 1)] * 100 + [(1, 0)] * 800 + [(1, 1)] * 200, "arm int, y int")
    r = experiments.analyse(units, "arm", "y", 0).first()
    assert r["winner"] == "1" and r["lift"] == 1.0 and r["p_value"] < 1e-6


def test_forecast_of_a_constant_series(spark):
    s = spark.sql("select date_add(date'2024-01-01', cast(id as int)) as ds, 10.0D as y from range(60)")
    f = forecast.predict(forecast.model(s, [], "2024-02-20"), [], "2024-02-20", 7)
    t = forecast.total(f, [], 7).first()
    assert (t["total"], t["lo95"], t["hi95"]) == (70.0, 70.0, 70.0)


def test_splits_and_algorithms(spark):
    got = spark.range(100).withColumn("s", models.split("id")).groupBy("s").count().collect()
    assert {r["s"]: r["count"] for r in got} == {"train": 70, "validation": 20, "holdout": 10}
    assert models.algorithms("clustering")[0] == "kmeans" and models.algorithms("?") == ("xgboost",)


def test_tiers(spark):
    t = customers.value_tiers(spark.range(9).select("id", F.col("id").cast("double").alias("s")), "s", "id")
    assert [r["tier"] for r in t.orderBy("id").collect()] == [1, 1, 1, 2, 2, 2, 3, 3, 3]


def test_a_chain_is_walked_to_its_end(spark):
    e = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(30)], "source string, target string")
    assert catalog.reach(e, spark.createDataFrame([("n0",)], "id string")).count() == 30


def test_empty_and_one_class_input(spark):
    from voltlake.operators import aggregates, drift, experiments, features, metrics, windows

    one = spark.createDataFrame([(0.1, 1, 1), (0.2, 1, 2)], "s double, y int, k int")
    assert {r["fpr"] for r in metrics.roc_points(one, "s", "y").collect()} == {None}
    assert {r["lift"] for r in windows.lift_deciles(one.withColumn("y", F.lit(0)), "s", "y", "k").collect()} == {None}
    for cur in (0, 1):
        assert drift.psi(one, ["s"], F.lit(cur)).first()["psi"] is None
        assert drift.ks(one, ["s"], F.lit(cur)).first()["ks"] is None
    none = one.where("false").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    assert aggregates.row_stats(none, "ts", "2024-01-02").first()["completeness"] is None
    assert features.completeness(none, ["s"]).first()["completeness"] is None
    arms = spark.createDataFrame([(a, int(a > 0)) for a in (0, 0, 1, 1)], "arm int, hit int")
    assert experiments.analyse(arms, "arm", "hit", 0).first()["lift"] is None


def test_search_splits_words_as_documents_are(spark):
    from voltlake.operators import retrieval

    docs = spark.createDataFrame([(1, "foo_bar baz"), (2, "other")], "doc_id int, text string")
    assert [r["doc_id"] for r in retrieval.search(docs, "doc_id", "text", "foo_bar").collect()] == [1]


def test_many_labels(spark):
    from voltlake.operators import retrieval

    v = spark.range(1500).select(F.col("id").alias("i"), F.array(F.cos(F.col("id") / 477.0), F.sin(F.col("id") / 477.0)).cast("array<float>").alias("e"), F.col("id").alias("l"))
    got = retrieval.relevance(v, "i", "e", "l", 1)
    assert got.count() == 1500


def test_dead_letter_takes_any_schema(spark):
    from voltlake.sources import files

    raw = spark.createDataFrame([(1, '{"a": 1.25, "b": {"x": 2}}'), (2, "{"), (3, None)], "id int, j string")
    good, bad = files.dead_letter(raw, "j", "a decimal(10,2), b struct<x:int>")
    assert [(r.id, str(r.a), r.b.x) for r in good.collect()] == [(1, "1.25", 2)] and sorted(r.id for r in bad.collect()) == [2, 3]
