"""Catalogue records and lineage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlake.operators.privacy import name_is_pii
from voltlake.operators.windows import first_occurrence
from voltlake.session import checkpointed

ENTRY = ("database string, `table` string, location string, format string, partitions array<string>, "
         "schema array<struct<name: string, type: string, pii: boolean>>")


def layer(uri: Column) -> Column:
    return (F.when(uri.contains("/bronze/"), "bronze").when(uri.contains("/silver/"), "silver")
            .when(uri.contains("/gold/"), "gold").otherwise("unknown"))


def lineage_nodes(events: DataFrame, order: str) -> DataFrame:
    """Source and target datasets of lineage events; the first mention of each stays."""
    s = events.select(F.col("source_uri").alias("id"), F.col(order).alias("first_event"), F.lit(0).alias("side"))
    t = events.select(F.col("target_uri").alias("id"), F.col(order).alias("first_event"), F.lit(1).alias("side"))
    return first_occurrence(s.unionByName(t), "id", ["first_event", "side"]).select(
        "*", F.lit("dataset").alias("type"), layer(F.col("id")).alias("layer"))


def lineage_graph(events: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """Nodes without repeats and edges with all repeats."""
    edges = events.select(F.col("source_uri").alias("source"), F.col("target_uri").alias("target"), "transformation", "ts")
    return lineage_nodes(events, order), edges


def reach(edges: DataFrame, seeds: DataFrame, upstream: bool = False, rounds: list | None = None) -> DataFrame:
    """Datasets reachable from each seed with their smallest depth; a pair is kept once, so cycles end.

    The distance doubles: what is known within 2^k steps is joined with the pairs that are exactly 2^k steps apart, until a round
    finds nothing new, so a walk of depth d takes about log2(d) rounds. Each round is checkpointed in the shared folder: the plan does not grow and a lost executor does
    not restart the walk. ``rounds`` gets the number of new pairs of each round.
    """
    a, b = ("target", "source") if upstream else ("source", "target")
    steps = checkpointed(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null").distinct())
    seen = checkpointed(seeds.where("id is not null").select(F.col("id").alias("root"), F.col("id").alias("node"), F.lit(0).alias("depth")).distinct())
    n, k = seen.count(), 0
    while True:
        far = seen.join(steps, seen["node"] == steps["a"]).select("root", F.col("b").alias("node"), (F.col("depth") + F.lit(1 << k)).alias("depth"))
        seen = checkpointed(seen.unionByName(far).groupBy("root", "node").agg(F.min("depth").alias("depth")))
        now = seen.count()
        if rounds is not None:
            rounds.append(now - n)
        if now == n:
            return seen.where("depth > 0")
        n, k = now, k + 1
        other = steps.select(F.col("a").alias("c"), F.col("b").alias("d"))
        steps = checkpointed(steps.join(other, F.col("b") == F.col("c")).select("a", F.col("d").alias("b")).distinct())


def discover(spark: SparkSession, root: str, database: str, names: list[str], extension: str = "parquet") -> DataFrame:
    """Catalogue entries of the datasets below a folder; schemas and the place of one file of each dataset are read."""
    rows = []
    for n in names:
        loc = f"{root}/{n}.{extension}"
        df = spark.read.format(extension).load(loc)
        fields, file = df.schema.fields, df.select("_metadata.file_path").first()
        below = file[0].rpartition(f"/{n}.{extension}")[2] if file else ""
        partitions = [x.split("=")[0] for x in below.split("/")[:-1] if "=" in x]
        rows.append((database, n, loc, extension, partitions, [(f.name, f.dataType.simpleString(), None) for f in fields]))
    return flag_pii(spark.createDataFrame(rows, ENTRY))


def flag_pii(entries: DataFrame) -> DataFrame:
    """Set the flag of every column whose name says so; flags set by hand stay."""
    return entries.withColumn("schema", F.transform("schema", lambda c: F.struct(
        c["name"].alias("name"), c["type"].alias("type"), (name_is_pii(c["name"]) | F.coalesce(c["pii"], F.lit(False))).alias("pii"))))


def catalog_records(entries: DataFrame, at: Column) -> DataFrame:
    """Update records: known format or JSON, partition keys always typed string."""
    return entries.select(
        F.col("database").alias("DatabaseName"), F.col("table").alias("Name"),
        F.struct(
            F.col("location").alias("Location"),
            F.when(F.col("format") == "parquet", "parquet").otherwise("json").alias("InputFormat"),
            F.transform(F.coalesce("schema", F.array().cast("array<struct<name: string, type: string, pii: boolean>>")),
                        lambda c: F.struct(c["name"].alias("Name"), c["type"].alias("Type"))).alias("Columns"),
        ).alias("StorageDescriptor"),
        F.transform(F.coalesce("partitions", F.array().cast("array<string>")),
                    lambda p: F.struct(p.alias("Name"), F.lit("string").alias("Type"))).alias("PartitionKeys"),
        at.alias("UpdateTime"))


def columns_of(df: DataFrame, name: str) -> DataFrame:
    rows = [(name, f.name, f.dataType.simpleString(), i) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "dataset string, name string, type string, pos int")


def schema_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Added, removed and retyped columns of two column tables."""
    o = old.select("dataset", "name", F.col("type").alias("old_type"))
    n = new.select("dataset", "name", F.col("type").alias("new_type"))
    change = (F.when(F.col("old_type").isNull(), "added").when(F.col("new_type").isNull(), "removed")
              .when(F.col("old_type") != F.col("new_type"), "retyped"))
    return o.join(n, ["dataset", "name"], "full_outer").withColumn("change", change).where(F.col("change").isNotNull())


def column_values(df: DataFrame, name: str) -> DataFrame:
    """The columns of a stored dataset with their numbers of values, counted in one pass."""
    n = df.agg(*[F.count(F.col(f.name)).alias(f.name) for f in df.schema.fields])
    pairs = F.array(*[F.struct(F.lit(f.name).alias("name"), F.col(f.name).alias("values")) for f in df.schema.fields])
    return n.select(F.inline(pairs)).join(F.broadcast(columns_of(df, name)), "name")  # one row a column


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
