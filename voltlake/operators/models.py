"""Churn base table, splits, leakage checks and model jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlake.functions.scalars import money


def churn_base(orders: DataFrame, cutoff: str, horizon_days: int) -> DataFrame:
    """Customers with an order up to the cutoff; label 1 when none follows within the horizon.

    Both sides of the question are answered by one aggregate over the orders, so there is no self join.
    """
    at, cut = F.col("o_orderdate"), F.lit(cutoff).cast("timestamp_ntz")
    until = F.lit(cutoff).cast("date") + F.expr(f"interval '{horizon_days}' day")
    before, after = at <= cut, (at > cut) & (at <= until.cast("timestamp_ntz"))
    g = orders.groupBy(F.col("o_custkey").alias("custkey")).agg(
        F.count_if(before).alias("n"), F.sum(F.when(before, money("o_totalprice"))).alias("spend"),
        F.max(F.when(before, at)).alias("last_o"), F.count_if(after).alias("later"))
    recency = F.datediff(F.lit(cutoff).cast("date"), F.col("last_o").cast("date"))
    return g.where("n > 0").select(
        "custkey", "n", "spend", recency.alias("recency"), F.when(F.col("later") == 0, 1).otherwise(0).alias("label"),
        (recency / (recency + F.lit(180.0))).alias("score"))


SPLITS = ("train", "train", "train", "train", "train", "train", "train", "validation", "validation", "holdout")
# Algorithms proposed per kind of problem, the search grid and the search size.
ALGORITHMS = {
    "binary_classification": ("xgboost", "lightgbm", "random_forest"),
    "regression": ("xgboost", "lightgbm", "linear_regression"),
    "time_series": ("prophet", "lstm", "arima"),
    "clustering": ("kmeans", "dbscan", "gaussian_mixture"),
}
DEFAULT_ALGORITHMS = ("xgboost",)
TRIALS, FOLDS, MIN_ROWS = 20, 5, 10_000


def algorithms(problem: str) -> tuple[str, ...]:
    return ALGORITHMS.get(problem, DEFAULT_ALGORITHMS)


def split(key) -> "F.Column":
    """70/20/10 split by key, stable across runs."""
    r = F.pmod(F.col(key), F.lit(10))
    return F.when(r <= 6, "train").when(r <= 8, "validation").otherwise("holdout")


def split_by_time(ts, validation_from: str, holdout_from: str) -> "F.Column":
    c = F.col(ts)
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return F.when(c < at(validation_from), "train").when(c < at(holdout_from), "validation").otherwise("holdout")


def split_report(df: DataFrame, split_col: str, label: str, min_rows: int = MIN_ROWS) -> DataFrame:
    """Size and label rate of each split."""
    return df.groupBy(split_col).agg(F.count("*").alias("n"), F.round(F.avg(label), 6).alias("label_rate")).withColumn(
        "large_enough", F.col("n") >= min_rows)


def leakage(pairs: DataFrame, feature_ts: str, label_ts: str, splits: DataFrame, key: str, features: list[str], label: str, limit: float = 0.99) -> DataFrame:
    """Features newer than their label, keys in more than one split, and features that all but equal the label."""
    late = pairs.agg(F.count_if(F.col(feature_ts) > F.col(label_ts)).alias("future_features"))
    shared = splits.groupBy(key).agg((F.min("split") != F.max("split")).alias("s")).agg(F.count_if("s").alias("shared_keys"))
    near = splits.agg(sum((F.coalesce(F.abs(F.corr(F.col(f).cast("double"), F.col(label).cast("double"))) > limit, F.lit(False)).cast("int") for f in features), F.lit(0)).alias("near_label"))
    # three one-row results side by side
    rows = late.select(F.lit("future_features").alias("k"), F.col("future_features").alias("v")).unionAll(
        shared.select(F.lit("shared_keys"), "shared_keys")).unionAll(near.select(F.lit("near_label"), F.col("near_label").cast("long")))
    names = ["future_features", "shared_keys", "near_label"]
    return rows.agg(*[F.max(F.when(F.col("k") == n, F.col("v"))).alias(n) for n in names]).withColumn("leak", F.expr("future_features + shared_keys + near_label > 0"))


def explain_linear(df: DataFrame, key: str, coefficients: dict[str, float]) -> tuple[DataFrame, DataFrame]:
    """Exact attributions of a linear model, coefficient x (value - mean), per row and as mean absolute value."""
    means = df.agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in coefficients]).first()  # one number per feature
    rows = df.select(key, *[(F.lit(float(b)) * (F.col(f).cast("double") - F.lit(means[f]))).alias(f) for f, b in coefficients.items()])
    top = F.array_max(F.array(*[F.struct(F.abs(f).alias("w"), F.lit(f).alias("f")) for f in coefficients]))["f"]
    imp = rows.agg(*[F.avg(F.abs(f)).alias(f) for f in coefficients]).select(
        F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("importance")) for f in coefficients])))
    return rows.withColumn("top_driver", top), imp


def pipeline(features: list[str], label: str = "label", kind: str = "logistic", max_iter: int = 20):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    stages = [VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features")]
    if kind == "logistic":
        stages.append(LogisticRegression(labelCol=label, maxIter=max_iter))
    else:
        stages.append(GBTClassifier(labelCol=label, maxIter=max_iter, maxDepth=4, seed=7))
    return Pipeline(stages=stages)


def train(df: DataFrame, features: list[str], key: str, label: str = "label", kind: str = "logistic", threshold: float = 0.5):
    """Fit on the training split; metrics on validation and holdout rows, each computed as a Spark aggregate."""
    from voltlake.operators import metrics as M

    numbered = df.select(key, label, *[F.col(f).cast("double").alias(f) for f in features]).withColumn("split", split(key))
    model = stored(pipeline(features, label, kind).fit(numbered.where("split = 'train'")), df.sparkSession)
    scored = predict(model, numbered.where("split <> 'train'"))
    one = lambda d: d.withColumn("_k", F.lit(1))
    m = one(M.auc(scored, "churn_score", label)).join(one(M.confusion(scored, "churn_score", label, threshold)), "_k").join(
        one(M.ece(scored, "churn_score", label)), "_k").drop("_k")
    return model, m


def stored(model, spark, uri: str | None = None):
    """The model as read back from its folder: what later jobs score with, free of the state of its training run."""
    from pyspark.ml import PipelineModel

    from voltlake.session import scratch

    uri = uri or scratch(spark, "model")
    model.write().overwrite().save(uri)
    return PipelineModel.load(uri)


def predict(model, df: DataFrame, name: str = "churn_score") -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    out = model.transform(df)
    return out.select(*df.columns, vector_to_array("probability")[1].alias(name))


def tune(df: DataFrame, features: list[str], label: str = "label", trials: int = TRIALS, folds: int = FOLDS, seed: int = 7) -> DataFrame:
    """Random search with cross-validation; one output row per trial."""
    import random

    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator

    from voltlake.session import checkpointed

    *prepare, lr = pipeline(features, label).getStages()
    data = checkpointed(df.select(label, *[F.col(f).cast("double").alias(f) for f in features]))
    # the features are prepared once; only the estimator is fitted per trial and fold
    for stage in prepare:
        data = (stage.fit(data) if hasattr(stage, "fit") else stage).transform(data)
    rng = random.Random(seed)
    grid = [{lr.regParam: round(10 ** rng.uniform(-4, 0), 6), lr.elasticNetParam: round(rng.random(), 3)} for _ in range(trials)]
    cv = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(labelCol=label), numFolds=folds, seed=seed, parallelism=8)
    scores = cv.fit(data.select("features", label)).avgMetrics
    rows = [(i, g[lr.regParam], g[lr.elasticNetParam], float(s)) for i, (g, s) in enumerate(zip(grid, scores))]
    return df.sparkSession.createDataFrame(rows, "trial int, reg_param double, elastic_net double, auc double")
