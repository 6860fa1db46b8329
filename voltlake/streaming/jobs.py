"""Structured Streaming jobs. Every sink is idempotent per micro-batch, so a replayed batch changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlake.functions.ordered import neighbour, running_total, time_slot
from voltlake.functions.scalars import ds_text
from voltlake.operators import ops as O
from voltlake.operators import quality as Q
from voltlake.operators.cost import level
from voltlake.streaming import stateful


def source(spark: SparkSession, path: str, schema: str, ts: str = "ts", max_files: int | None = None) -> DataFrame:
    """File stream with event time as an instant; watermarks need one."""
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path).withColumn(ts, F.col(ts).cast("timestamp"))


def drain(writer, checkpoint: str):
    """Process everything available now, remember the position, and return the query for its progress."""
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def processed(query) -> tuple[int, int]:
    """Rows processed and the last batch number, from the progress reports."""
    p = query.recentProgress
    return sum(x.numInputRows for x in p), max((x.batchId for x in p), default=-1)


def _replace(df: DataFrame, path: str, by: list[str]) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def ingest(stream: DataFrame, path: str, checkpoint: str, ts: str = "ts"):
    """Land a stream as day partitions; the file sink's log makes it exactly once."""
    return drain(stream.withColumn("ds", ds_text(ts)).writeStream.format("parquet").partitionBy("ds").option("path", path), checkpoint)


def dedup(stream: DataFrame, keys: list[str], lateness: str, path: str, checkpoint: str, ts: str = "ts"):
    """Drop repeats of a key that arrive within the lateness bound; older keys leave the state."""
    return drain(stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(keys).writeStream.format("parquet").option("path", path), checkpoint)


def _layer(path: str) -> Callable[[DataFrame, int], None]:
    """What a batch changed, in a folder of its own that a replay replaces."""
    return lambda df, i: _replace(df.withColumn("batch", F.lit(i)), path, ["batch"])


def merged(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """The last row of every key over all layers."""
    layers = spark.read.schema(f"{schema}, batch int").parquet(path)
    rest = [c for c in layers.columns if c not in (*keys, "batch")]
    return layers.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def _windows(stream: DataFrame, period: str, lateness: str, keys: list[str], aggs: dict[str, Column], ts: str) -> DataFrame:
    g = stream.withWatermark(ts, lateness).groupBy(F.window(ts, period).alias("w"), *keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return g.select(F.col("w.start").alias("start"), *keys, *aggs)


def tumbling(stream: DataFrame, period: str, keys: list[str], aggs: dict[str, Column], path: str, checkpoint: str, ts: str = "ts", lateness: str = "1 day"):
    """Windows as they fill: a batch writes those it changed, state holds those that rows within ``lateness`` can still reach. Read with ``merged``."""
    return drain(_windows(stream, period, lateness, keys, aggs, ts).writeStream.outputMode("update").foreachBatch(_layer(path)), checkpoint)


def closed_windows(stream: DataFrame, period: str, lateness: str, keys: list[str], aggs: dict[str, Column], path: str, checkpoint: str, ts: str = "ts"):
    """Windows written once, when the watermark has passed them; state holds open windows only."""
    return drain(_windows(stream, period, lateness, keys, aggs, ts).writeStream.outputMode("append").format("parquet").option("path", path), checkpoint)


def panes(stream: DataFrame, step: str, keys: list[str], path: str, checkpoint: str, ts: str = "ts", lateness: str = "1 day"):
    """Counts of the steps that sliding windows are made of: every row goes to one of them, however many windows hold it."""
    return tumbling(stream, step, keys, {"n": F.count("*")}, path, checkpoint, ts, lateness)


def sliding(counts: DataFrame, length: int, step: int, keys: list[str], least: int = 1) -> DataFrame:
    """(start, keys, n) of the windows of ``length`` seconds every ``step`` seconds with at least ``least`` rows, from panes (start, keys, n).

    A pane enters the windows at one start and leaves them at another, so two rows a pane are summed in order; starts in between are filled in at the end.
    """
    if length % step:
        raise ValueError("the length must be a multiple of the step")
    at = F.unix_micros("start")
    enter = counts.select(*keys, (at - F.lit((length - step) * 1_000_000)).alias("_at"), F.col("n").alias("_d"))
    leave = counts.select(*keys, (at + F.lit(step * 1_000_000)).alias("_at"), (-F.col("n")).alias("_d"))
    points = enter.union(leave).groupBy(*keys, "_at").agg(F.sum("_d").alias("_d"))
    slot = time_slot(F.col("_at"), 64 * length)
    run = running_total(points, keys, slot, ["_at"], {"n": F.col("_d")})
    run = neighbour(run, keys, slot, ["_at"], {"_next": "_at"}, following=True).where(F.col("n") >= max(1, least))
    starts = F.explode(F.sequence(F.col("_at"), F.col("_next") - F.lit(step * 1_000_000), F.lit(step * 1_000_000)))
    return run.select(starts.alias("_s"), *keys, "n").select(F.timestamp_micros("_s").alias("start"), *keys, "n")


def budget_alerts(stream: DataFrame, cost: str, budget: float, path: str, checkpoint: str, ts: str = "ts"):
    """Daily spend so far whenever it changes, with its alarm level; only days above the first level are kept."""
    day = F.window(ts, "1 day").alias("w")
    g = stream.groupBy(day).agg(F.sum(F.col(cost).cast("decimal(18,2)")).alias("spend"))

    def sink(df: DataFrame, i: int) -> None:
        lv = level(F.col("spend").cast("double") / F.lit(budget) * 100)
        _replace(df.select(F.col("w.start").alias("start"), "spend", lv.alias("level"), F.lit(i).alias("batch")).where("level <> 'ok'"), path, ["batch"])

    return drain(g.writeStream.outputMode("update").foreachBatch(sink), checkpoint)


def recurring_errors(stream: DataFrame, keys: list[str], path: str, checkpoint: str, hours: int = 24, threshold: int = 3, ts: str = "ts", lateness: str = "1 hour"):
    """Errors that are the third or later of their kind within the trailing span, from keyed state. Read with ``merged`` by keys and ``at``."""
    spark = stream.sparkSession
    before = {k: spark.conf.get(k) for k in stateful.STORE}
    found = stateful.trailing_counts(stream, keys, ts, hours * 3600, threshold, lateness)
    try:
        for k, v in stateful.STORE.items():
            spark.conf.set(k, v)
        return drain(found.writeStream.outputMode("update").foreachBatch(_layer(path)), checkpoint)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def recounted_errors(stream: DataFrame, keys: list[str], store: str, path: str, checkpoint: str, hours: int = 24, threshold: int = 3, ts: str = "ts"):
    """Errors that are the third or later of their kind within the trailing span.

    For keys too frequent for one task. No per-key state: each batch is stored by day, and the days its span reaches are counted again with
    the skew-safe trailing count and replaced. Late and repeated batches lead to the same result.
    """

    def sink(df: DataFrame, i: int) -> None:
        spark = df.sparkSession
        _replace(df.select(*keys, ts, ds_text(ts).alias("ds"), F.lit(i).alias("batch")), store, ["ds", "batch"])
        back = (hours + 23) // 24
        touched = df.where(F.col(ts).isNotNull()).select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(back)), lambda n: F.date_add(F.to_date(ts), n))).alias("d")).distinct()
        days = [r[0] for r in touched.collect()]  # days of one batch
        if not days:
            return
        names = {d.strftime("%Y%m%d") for d in days}
        need = {p for d in days for p in _days_before(d, back)}
        hist = spark.read.option("basePath", store).parquet(store).where(F.col("ds").cast("string").isin(sorted(need)))
        freq = O.error_frequency(hist.select(*keys, ts), keys, ts, hours, threshold).where("recurring")
        out = freq.withColumn("ds", F.date_format(F.timestamp_micros("at"), "yyyyMMdd")).where(F.col("ds").isin(sorted(names)))
        _replace(out, path, ["ds"])

    return drain(stream.writeStream.foreachBatch(sink), checkpoint)


def _days_before(d, back: int):
    from datetime import timedelta

    return [(d - timedelta(days=i)).strftime("%Y%m%d") for i in range(back + 1)]


def late_rows(stream: DataFrame, ts: str, arrival: str, hours: float, path: str, late_path: str, checkpoint: str):
    """Rows that arrived later than the freshness limit go to a side table."""
    late = (F.unix_micros(F.col(arrival)) - F.unix_micros(F.col(ts))) / F.lit(3.6e9) > hours

    def sink(df: DataFrame, i: int) -> None:
        tagged = df.withColumn("batch", F.lit(i))
        _replace(tagged.where(~late), path, ["batch"])
        _replace(tagged.where(late), late_path, ["batch"])

    return drain(stream.writeStream.foreachBatch(sink), checkpoint)


def online_features(stream: DataFrame, key: str, values: list[str], order: list[str], path: str, checkpoint: str):
    """Latest row per key, kept as small per-batch layers that readers merge.

    A batch writes at most one row per key it saw; nothing already stored is rewritten.
    """

    def sink(df: DataFrame, i: int) -> None:
        best = df.groupBy(key).agg(F.max(F.struct(*order, *values)).alias("r")).select(key, "r", F.lit(i).alias("batch"))
        _replace(best, path, ["batch"])

    return drain(stream.writeStream.foreachBatch(sink), checkpoint)


def read_online(spark: SparkSession, path: str, key: str) -> DataFrame:
    return spark.read.parquet(path).groupBy(key).agg(F.max("r").alias("r")).select(key, "r.*")


def compact_online(spark: SparkSession, path: str, out: str, key: str) -> None:
    """Merge the layers into one, in a new folder."""
    spark.read.parquet(path).groupBy(key).agg(F.max("r").alias("r")).withColumn("batch", F.lit(-1)).write.partitionBy("batch").parquet(out)


def quality_gate(stream: DataFrame, suite: list[Q.Expect], good: str, blocked: str, results: str, checkpoint: str):
    """Run a suite on every micro-batch; a batch that fails is kept apart from its consumers."""

    def sink(df: DataFrame, i: int) -> None:
        df = df.persist()
        try:
            res = Q.validate(df, suite).withColumn("batch", F.lit(i))
            _replace(res, results, ["batch"])
            passed = df.sparkSession.read.parquet(results).where((F.col("batch") == i) & ~F.col("success")).isEmpty()
            _replace(df.withColumn("batch", F.lit(i)), good if passed else blocked, ["batch"])
        finally:
            df.unpersist()

    return drain(stream.writeStream.foreachBatch(sink), checkpoint)
