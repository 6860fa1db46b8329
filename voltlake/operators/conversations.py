"""Conversation log analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlake.functions.ordered import running_total, value_slot
from voltlake.functions.scalars import r6


def summary(log: DataFrame, key: str, user: str, ts: str, closed) -> DataFrame:
    """User, messages, status, first and last message and seconds between, per conversation."""
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    g = log.groupBy(key).agg(
        F.min(user).alias("user_id"), F.count("*").alias("message_count"), F.when(F.max(closed.cast("int")) == 1, "closed").otherwise("active").alias("status"),
        F.min(ts).alias("start_time"), F.max(ts).alias("end_time"))
    return g.withColumn("duration_seconds", r6((us(F.col("end_time")) - us(F.col("start_time"))) / F.lit(1e6)))


def by_user(log: DataFrame, user: str, key: str) -> DataFrame:
    return log.groupBy(user, key).agg(F.count("*").alias("message_count"))


def merge_context(updates: DataFrame, key: str, name: str, value: str, seq: str) -> DataFrame:
    """Context of each conversation as one row per entry; the last update of an entry wins."""
    return updates.groupBy(key, name).agg(F.max_by(value, seq).alias(value))


def append(log: DataFrame, new: DataFrame, known: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """The log with new messages numbered ``msg-n`` by position, and messages of unknown conversations."""
    orphans = new.join(known, key, "left_anti")
    both = log.unionByName(new.join(known, key, "left_semi"))
    numbered = running_total(both, [key], lambda: value_slot(both, order), [order], {"pos": F.lit(1)})
    return numbered.withColumn("message_id", F.format_string("msg-%d", "pos")).drop("pos"), orphans
