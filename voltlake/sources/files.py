"""File sources and sinks: landing, listing, quarantine, fallback, compaction, JSON and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltlake.functions.scalars import ds_text

LINEAGE = ("source_uri string, target_uri string, transformation string, agent_name string, run_id string, "
           "records_out long, timestamp string, metadata map<string,string>, ds string")


def write_partitioned(df: DataFrame, path: str, ds: str = "ds") -> None:
    """Overwrite only the partitions present in ``df``.

    Rows of a partition are brought together, so that it gets few files; adaptive execution splits a partition that is
    too large for one writer and merges small ones.
    """
    even = df.hint("rebalance", F.col(ds))
    even.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "snappy").partitionBy(ds).parquet(path)


def land(df: DataFrame, path: str, date: str) -> dict:
    """Land a batch as ``ds=yyyyMMdd`` partitions and report its rows and the bytes of the partitions it replaced.

    Rows are observed while they are written, so other writers and equal time stamps do not matter; the data is not scanned again.
    """
    spark = df.sparkSession
    seen = Observation()
    batch = df.withColumn("ds", ds_text(date))
    write_partitioned(batch.observe(seen, F.count("*").alias("n"), F.collect_set("ds").alias("ds")), path)
    got = seen.get
    own = F.regexp_extract("path", r"/ds=([^/]*)/", 1)
    fresh = listing(spark, path).where(own.isin([d or "__HIVE_DEFAULT_PARTITION__" for d in got["ds"]]))
    return {"target_uri": path, "records_ingested": got["n"], "bytes_written": fresh.agg(F.sum("length")).first()[0] if got["n"] else 0}


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder: path, length, modification time; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")


def qualified(spark: SparkSession, path: str) -> str:
    """The path as the file system writes it in listings, whatever form it is given in."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def list_objects(spark: SparkSession, root: str, prefix: str = "", max_keys: int | None = None, after: str | None = None) -> DataFrame:
    """Keys below ``root`` that start with ``prefix``, in order: all, or a page of ``max_keys`` behind the key ``after``."""
    at = len(qualified(spark, root).rstrip("/"))
    keys = listing(spark, root).select(F.expr(f"substring(path, {at + 2})").alias("key"), "length").where(F.col("key").startswith(prefix)).orderBy("key")
    keys = keys if after is None else keys.where(F.col("key") > after)
    return keys if max_keys is None else keys.limit(max_keys)


def exists(keys: DataFrame, objects: DataFrame) -> DataFrame:
    have = objects.select("key").distinct().withColumn("_hit", F.lit(True))
    return keys.join(have, "key", "left").select("key", F.coalesce("_hit", F.lit(False)).alias("exists"))


def incremental(source: DataFrame, landed: DataFrame, ts: str, key: str) -> DataFrame:
    """Rows newer than the landed high-water mark, and rows exactly at it that have not been landed."""
    mark = landed.agg(F.max(ts)).first()[0]  # one value
    if mark is None:
        return source
    at = F.lit(mark).cast(source.schema[ts].dataType)
    newer = source.where(F.col(ts) > at)
    ties = source.where(F.col(ts) == at).join(landed.where(F.col(ts) == at).select(key), key, "left_anti")
    return newer.unionByName(ties.select(*source.columns))


def duplicate_rate(df: DataFrame, keys: list[str], limit: float = 0.001) -> DataFrame:
    g = df.groupBy(*keys).agg(F.count("*").alias("n"))
    rate = 1 - F.count("*") / F.sum("n")
    return g.agg(F.sum("n").alias("records"), F.count("*").alias("distinct_records"), F.round(rate, 6).alias("duplicate_rate"), (rate <= limit).alias("within_target"))


def schema_violations(spark: SparkSession, actual: T.StructType, declared: T.StructType) -> DataFrame:
    """Differences that refuse a write; empty when the frame fits."""
    have = {f.name: f.dataType.simpleString() for f in actual.fields}
    want = {f.name: f.dataType.simpleString() for f in declared.fields}
    rows = [(n, want.get(n), have.get(n), "missing" if n not in have else "unexpected" if n not in want else "type")
            for n in sorted(have.keys() | want.keys()) if have.get(n) != want.get(n)]
    return spark.createDataFrame(rows, "name string, declared string, actual string, problem string")


class SchemaRefused(ValueError):
    """A write whose frame differs from the declared schema; nothing was written."""

    def __init__(self, violations: DataFrame):
        super().__init__(f"schema differs from the declared one: {[r.asDict() for r in violations.collect()]}")  # at most one row a column
        self.violations = violations


def gated_write(df: DataFrame, declared: T.StructType, path: str, ds: str = "ds") -> None:
    bad = schema_violations(df.sparkSession, df.schema, declared)
    if not bad.isEmpty():
        raise SchemaRefused(bad)
    write_partitioned(df, path, ds)


def dead_letter(raw: DataFrame, column: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Parsed rows, and rows whose JSON text cannot be parsed."""
    parsed = raw.withColumn("_p", F.from_json(column, f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("_p._bad").isNotNull() | F.col(column).isNull()
    keep = [c for c in raw.columns if c != column]
    names = T.StructType.fromDDL(schema).fieldNames()
    return parsed.where(~bad).select(*keep, *[F.col("_p").getField(n).alias(n) for n in names]), parsed.where(bad).select(*raw.columns)


def quarantine(df: DataFrame, bad: Column, clean_path: str, bad_path: str) -> None:
    """Split a partitioned frame; the bad side lands where no reader of the table looks."""
    flag = F.coalesce(bad, F.lit(False))
    write_partitioned(df.where(flag), bad_path)
    write_partitioned(df.where(~flag), clean_path)


def fallback_partition(spark: SparkSession, path: str, passed: DataFrame, ds: str) -> DataFrame:
    """Rows of the latest partition up to ``ds`` that passed its checks."""
    best = passed.where((F.col("ds") <= ds) & F.col("passed")).agg(F.max("ds")).first()[0]  # one value
    return spark.read.option("basePath", path).parquet(path).where(F.col("ds").cast("string") == F.lit(best))


def compact(spark: SparkSession, path: str, out: str, ds: str = "ds", keep_from: str | None = None) -> None:
    """Rewrite partitions with few files of the advisory size into a new folder and drop those before ``keep_from``."""
    df = spark.read.parquet(path)
    if keep_from:
        df = df.where(F.col(ds).cast("string") >= keep_from)
    df.hint("rebalance", F.col(ds)).write.mode("overwrite").partitionBy(ds).parquet(out)


def write_json(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path


def read_json(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def write_text(df: DataFrame, column: str, path: str) -> str:
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
    return path


def read_text(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    return spark.read.text(path, wholetext=whole)


def iso(ts: Column) -> Column:
    """ISO text of an instant; a fraction is written only when there is one."""
    whole = F.unix_micros(ts.cast("timestamp")) % 1_000_000 == 0
    return F.when(whole, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def serialize(c: Column, kind: T.DataType) -> Column:
    """Instants to ISO text through structs, maps and arrays of structs; an instant that stands in an array itself stays."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return iso(c)
    if isinstance(kind, T.StructType):
        return F.struct(*[serialize(c[f.name], f.dataType).alias(f.name) for f in kind.fields])
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: serialize(v, kind.valueType))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.MapType)):
        return F.transform(c, lambda v: serialize(v, kind.elementType))
    return c


def serialize_rows(df: DataFrame) -> DataFrame:
    return df.select(*[serialize(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def run_with_lineage(df: DataFrame, target: str, source: str, transformation: str, run_id: str, at: str = "2024-01-31T00:00:00") -> DataFrame:
    """Write a frame and return its lineage row; the rows are observed while they are written."""
    seen = Observation()
    df.observe(seen, F.count("*").alias("n")).write.mode("overwrite").parquet(target)
    row = (source, target, transformation, "etl", run_id, seen.get["n"], at, {}, at[:10].replace("-", ""))
    return df.sparkSession.createDataFrame([row], LINEAGE)


def append_lineage(row: DataFrame, path: str) -> None:
    row.write.mode("append").partitionBy("ds").parquet(path)

