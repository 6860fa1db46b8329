"""Helpers the text operators share: input tables, written intermediate tables, files on the shared store."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlake.session import scratch
from voltlake.tables import Lake

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def lake(spark: SparkSession, sf_dir: str) -> Lake:
    small_batches(spark)
    ship(spark)
    return Lake(spark, sf_dir)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, which need not have it installed (as --py-files does)."""
    sc = spark.sparkContext
    if getattr(sc, "_voltlake_sent", False):
        return
    root = Path(__file__).resolve().parents[1]
    if root.is_dir():
        file = Path(tempfile.mkdtemp(prefix="voltlake-")) / "voltlake.zip"
        with zipfile.ZipFile(file, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(file))
    sc._voltlake_sent = True


def small_batches(spark: SparkSession) -> None:
    """Texts and gathered groups can be long, so a batch sent to Python holds few rows and, beyond one row, few bytes."""
    spark.conf.set(ARROW_ROWS, "256")
    spark.conf.set(ARROW_BYTES, "8m")


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: computed once, and safe when executors are lost."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_key(c="text"):
    """128-bit key of a text; a null text counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(c), F.lit("")))).alias("tid")


def open_store(uri: str):
    """File system and path of a URI of the shared store, usable inside a task."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        uri = f"file://{uri}"
    elif uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def attempt_name(prefix: str, suffix: str) -> str:
    """A file name no other attempt of the same task uses; only names that reach a committed index are ever read."""
    from pyspark import TaskContext

    ctx = TaskContext.get()
    part = ctx.partitionId() if ctx else 0
    return f"{prefix}-{part:05d}-{uuid.uuid4().hex[:12]}{suffix}"
