"""Model metrics as distributed aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voltlake.functions.ordered import running_total, value_slot
from voltlake.functions.scalars import r6, ratio, share

# AUC from which a model counts as strong, and the AUC below which an alarm is raised.
STRONG_AUC, ALARM_AUC, MAX_AUC_DROP = 0.80, 0.78, 0.05


def _by_score(df: DataFrame, keys: list[str], score: str, label: str, descending: bool = False) -> DataFrame:
    """Positives and negatives per distinct score with running and whole counts."""
    s = F.col(score).cast("double")
    g = df.select(*keys, (-s if descending else s).alias("_s"), F.col(label).cast("int").alias("_y")).groupBy(*keys, "_s").agg(
        F.sum("_y").alias("pos"), F.sum(1 - F.col("_y")).alias("neg"))
    slot = lambda: value_slot(df.select((-s if descending else s).alias("_s")), "_s")
    return running_total(g, keys, slot, ["_s"], {"cum_pos": F.col("pos"), "cum_neg": F.col("neg")}, whole=True)


def auc(df: DataFrame, score: str, label: str, keys: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve with ties counted half; null when only one class is present."""
    keys = keys or []
    g = _by_score(df, keys, score, label)
    below = F.col("cum_neg") - F.col("neg")
    area = F.sum(F.col("pos").cast("double") * (below + F.col("neg") / 2.0))
    p, n = F.max("cum_pos_all").cast("double"), F.max("cum_neg_all").cast("double")
    return g.groupBy(*keys).agg(area.alias("_a"), p.alias("_p"), n.alias("_n")).select(
        *keys, F.when((F.col("_p") > 0) & (F.col("_n") > 0), F.round(F.col("_a") / (F.col("_p") * F.col("_n")), 6)).alias("auc"))


def roc_points(df: DataFrame, score: str, label: str) -> DataFrame:
    """One point per distinct score: rates of positives and negatives scored at or above it."""
    g = _by_score(df, [], score, label, descending=True)
    return g.select(r6(-F.col("_s")).alias("threshold"), r6(ratio("cum_pos", "cum_pos_all")).alias("tpr"),
                    r6(ratio("cum_neg", "cum_neg_all")).alias("fpr"))


def confusion(df: DataFrame, score: str, label: str, threshold: float) -> DataFrame:
    hit, y = F.col(score) >= threshold, F.col(label) == 1
    c = df.agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"), F.count_if(~hit & ~y).alias("tn"))
    div = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 6)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("*", div(tp, tp + fp).alias("precision"), div(tp, tp + fn).alias("recall"), div(2 * tp, 2 * tp + fp + fn).alias("f1"),
                    div(fp, fp + tn).alias("false_positive_rate"))


def calibration_bins(df: DataFrame, score: str, label: str, keys: list[str] | None = None) -> DataFrame:
    """Ten equal-width score bins; 1.0 belongs to the last one."""
    b = F.least(F.floor(F.col(score) * 10), F.lit(9)).cast("int")
    return df.groupBy(*(keys or []), b.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(label).alias("rate"))


def ece(df: DataFrame, score: str, label: str, keys: list[str] | None = None) -> DataFrame:
    """Expected calibration error."""
    keys = keys or []
    gap = F.sum(F.col("n") * F.abs(F.col("rate") - F.col("mean_score"))) / F.sum("n")
    return calibration_bins(df, score, label, keys).groupBy(*keys).agg(r6(gap).alias("calibration_error"))


def compare_runs(runs: DataFrame, baseline: str, run: str = "run") -> DataFrame:
    """Each run against the baseline run, ranked by quality, then by cost. One row per run."""
    b = runs.where(F.col(run) == baseline).select(F.lit(1).alias("_k"), F.col("auc").alias("_auc"), F.col("cost").alias("_cost"))
    j = runs.withColumn("_k", F.lit(1)).join(F.broadcast(b), "_k")
    w = W.orderBy(F.desc("auc"), "cost", run)
    return j.select(run, "auc", "cost", r6(F.col("auc") - F.col("_auc")).alias("auc_delta"), r6(F.col("cost") - F.col("_cost")).alias("cost_delta"),
                    (F.col("_auc") - F.col("auc") > MAX_AUC_DROP).alias("regression"), F.row_number().over(w).alias("rank_no"))


def registry_pick(versions: DataFrame, model: str, created: list[str], version: str, metric: str, floor: float) -> DataFrame:
    """Current and previous version per model; the previous one serves when the current one is below the floor."""
    w = W.partitionBy(model).orderBy(*[F.desc(c) for c in created])
    top = versions.withColumn("_r", F.row_number().over(w)).where("_r <= 2")
    pick = lambda r, c: F.max(F.when(F.col("_r") == r, F.col(c)))
    g = top.groupBy(model).agg(pick(1, version).alias("current"), pick(2, version).alias("previous"), pick(1, metric).alias("_m"))
    return g.select(model, "current", "previous", F.coalesce(F.when(F.col("_m") >= floor, F.col("current")), F.col("previous"), F.col("current")).alias("serving"))


def score_parity(a: DataFrame, b: DataFrame, key: str, score: str, tolerance: float, target: float = 0.98) -> DataFrame:
    j = a.select(key, F.col(score).alias("_a")).join(b.select(key, F.col(score).alias("_b")), key)
    s = share(F.abs(F.col("_a") - F.col("_b")) <= tolerance)
    return j.agg(F.count("*").alias("n"), r6(s).alias("parity"), (s >= target).alias("passed"))
