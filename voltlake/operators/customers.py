"""Segments and lifetime value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlake.functions.ordered import ranked, tile

TIERS = {1: "bronze", 2: "silver", 3: "gold"}


def lifetime_value(spend: DataFrame, years: float = 3.0, margin: float = 1.0) -> DataFrame:
    """Average order value x orders per year x years x margin, from spend, n_orders, first_o and last_o."""
    span = F.greatest(F.lit(1.0), F.datediff(F.col("last_o").cast("date"), F.col("first_o").cast("date")) / F.lit(365.25))
    return spend.withColumn("clv", (F.col("spend") / F.col("n_orders")) * (F.col("n_orders") / span) * F.lit(years * margin))


def value_tiers(df: DataFrame, spend: str, key: str, n: int = 3) -> DataFrame:
    """Equal-sized tiers by spend, ties by key; tier 1 spends least."""
    return ranked(df, spend, key).withColumn("tier", tile(F.col("rank_no"), F.col("rows_all"), n)).drop("rank_no", "rows_all")


def tier_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Customers per pair of tiers in two runs, with the share of all whose tier is unchanged."""
    from pyspark.sql import Window as W

    j = a.select(key, F.col("tier").alias("before")).join(b.select(key, F.col("tier").alias("after")), key)
    m = j.groupBy("before", "after").agg(F.count("*").alias("n"))
    every = W.partitionBy()  # one row per pair of tiers
    same = F.sum(F.when(F.col("before") == F.col("after"), F.col("n")).otherwise(0)).over(every) / F.sum("n").over(every)
    return m.withColumn("agreement", F.round(same, 6)).withColumn("stable", same >= 0.8)


def kmeans(df: DataFrame, vector: str, k: int, seed: int = 7, bisecting: bool = False):
    """Clusters and the silhouette of the result; the input is an array column."""
    from pyspark.ml.clustering import BisectingKMeans, KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    data = df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    est = BisectingKMeans(k=k, seed=seed) if bisecting else KMeans(k=k, seed=seed)
    out = est.fit(data).transform(data)
    return out, ClusteringEvaluator().evaluate(out)


def clv_holdout(orders: DataFrame, cutoff: str, days: int = 365) -> DataFrame:
    """Predicted and actual spend of the holdout period per customer seen before the cutoff, from one pass over the orders."""
    cut = F.lit(cutoff).cast("timestamp_ntz")
    d = F.col("o_orderdate")
    before = d < cut
    after = (~before) & (F.datediff(d.cast("date"), F.lit(cutoff).cast("date")) < days)
    m = F.col("o_totalprice").cast("decimal(18,2)")
    g = orders.groupBy("o_custkey").agg(
        F.count_if(before).alias("n"), F.sum(F.when(before, m)).cast("double").alias("spend"), F.min(F.when(before, d)).alias("first_o"),
        F.coalesce(F.sum(F.when(after, m)), F.lit(0)).cast("double").alias("actual"))
    years = F.greatest(F.lit(1.0), F.datediff(F.lit(cutoff).cast("date"), F.col("first_o").cast("date")) / F.lit(365.25))
    return g.where("n > 0").select("o_custkey", (F.col("spend") / years * F.lit(days / 365.25)).alias("predicted"), "actual")
