"""Attributions of tree ensembles: path-dependent Shapley values of each feature, exact, from the table of nodes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlake.session import scratch


def node_table(model, spark) -> DataFrame:
    """(tree, weight, id, left, right, feature, threshold, value, rows) of every node of a fitted ensemble, as it is stored; a leaf has no children."""
    path = scratch(spark, "ensemble")
    model.write().overwrite().save(path)
    n = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    w = spark.createDataFrame(list(enumerate(float(x) for x in model.treeWeights)), "tree int, weight double")
    return n.join(F.broadcast(w), n["treeID"] == w["tree"]).select(
        "tree", "weight", "id", F.col("leftChild").alias("left"), F.col("rightChild").alias("right"), F.col("split.featureIndex").alias("feature"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"), F.col("prediction").alias("value"), F.col("rawCount").cast("double").alias("rows"))


def leaves(nodes: list) -> list[tuple[float, dict[int, tuple[float, float, float]]]]:
    """Of each leaf its weighted value and, by feature of its path, (above, up to, fraction): the bounds its values keep to, and the share of training rows that
    the splits by it let through, multiplied down the levels."""
    out = []
    by = {(r["tree"], r["id"]): r for r in nodes}
    todo = [(r, {}) for r in nodes if r["id"] == 0]
    while todo:
        r, path = todo.pop()
        if r["left"] < 0:
            out.append((r["weight"] * r["value"], path))
            continue
        low, high, share = path.get(r["feature"], (-math.inf, math.inf, 1.0))
        for child, bounds in ((r["left"], (low, min(high, r["threshold"]))), (r["right"], (max(low, r["threshold"]), high))):
            c = by[r["tree"], child]
            todo.append((c, {**path, r["feature"]: (*bounds, share * c["rows"] / r["rows"])}))
    return out


def shapley(x, found: list, n_features: int):
    """(rows, features) of attributions and the expected value. ``x`` holds a row of features a line."""
    import numpy as np

    out, base = np.zeros((len(x), n_features)), 0.0
    for value, path in found:
        features = list(path)
        one = [((x[:, f] > path[f][0]) & (x[:, f] <= path[f][1])).astype(float) for f in features]
        zero = [path[f][2] for f in features]
        base += value * math.prod(zero)
        d = len(features)
        for i, f in enumerate(features):
            # coefficients of the product of (zero + one t) over the other features: the sums over subsets of each size
            poly = [np.ones(len(x))]
            for j in range(d):
                if j != i:
                    poly = [(poly[k] * zero[j] if k < len(poly) else 0.0) + (poly[k - 1] * one[j] if k else 0.0) for k in range(len(poly) + 1)]
            weights = [math.factorial(k) * math.factorial(d - 1 - k) / math.factorial(d) for k in range(d)]
            out[:, f] += value * (one[i] - zero[i]) * sum(w * p for w, p in zip(weights, poly))
    return out, base


def explain_trees(model, df: DataFrame, key: str, features: list[str]) -> DataFrame:
    """(key, features, base, raw, top_driver) of every row: what each feature adds to the expected raw score of a fitted pipeline whose last stage is a tree ensemble.

    The attributions of a row add up to raw - base. The nodes, a bounded table that comes with the model, are sent to the tasks; rows are read once.
    """
    from pyspark.ml.functions import vector_to_array

    spark = df.sparkSession
    found = leaves(node_table(model.stages[-1], spark).collect())  # the model
    ready = df
    for stage in model.stages[:-1]:
        ready = stage.transform(ready)
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            x = b.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            values, base = shapley(x, found, len(features))
            top = [features[i] for i in np.abs(values).argmax(axis=1)] if b.num_rows else []
            yield pa.RecordBatch.from_arrays(
                [b.column(key), *(pa.array(values[:, i]) for i in range(len(features))), pa.array(np.full(b.num_rows, base)), pa.array(values.sum(axis=1) + base), pa.array(top, pa.string())],
                [key, *features, "base", "raw", "top_driver"])

    schema = f"`{key}` {kind}, " + ", ".join(f"`{f}` double" for f in features) + ", base double, raw double, top_driver string"
    return ready.select(key, vector_to_array("features").alias("_x")).mapInArrow(run, schema)
