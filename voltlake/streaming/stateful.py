"""Keyed state: trailing counts of a key's events, kept in list state until an event-time timer says that the key is quiet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def trailing_counts(stream: DataFrame, keys: list[str], ts: str, seconds: int, threshold: int, lateness: str) -> DataFrame:
    """(keys, at, n) whenever an event leaves ``n`` events of its key, at least ``threshold``, in the span that ends at time ``at`` (micros); the oldest instant is excluded.

    A key's state is the times and counts of its last span, and nothing once the watermark is a span past its last event. An event that comes late, but before the
    watermark, counts again what it reaches, so the last row for a (key, at) is the right one. The events of one key within one span are one task's work.
    """
    from pyspark.sql.streaming import StatefulProcessor

    span = seconds * 1_000_000
    schema = ", ".join(f"`{k}` {stream.schema[k].dataType.simpleString()}" for k in keys) + ", at long, n long"

    class TrailingCounts(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.times = handle.getListState("times", "at long, n long")

        def handleInputRows(self, key, rows, timerValues):
            import numpy as np
            import pandas as pd

            new, n = np.unique(pd.concat([r["at_micros"] for r in rows]).to_numpy(dtype=np.int64), return_counts=True)
            held = np.array([tuple(x) for x in self.times.get()] if self.times.exists() else [], dtype=np.int64).reshape(-1, 2)
            times, own = np.unique(np.concatenate([held[:, 0], new]), return_inverse=True)
            count = np.zeros(len(times), dtype=np.int64)
            np.add.at(count, own, np.concatenate([held[:, 1], n]))
            total = np.append(0, np.cumsum(count))
            trailing = total[1:] - total[np.searchsorted(times, times - span, side="right")]
            changed = np.searchsorted(new, times, side="right") > np.searchsorted(new, times - span, side="right")
            kept = times > timerValues.getCurrentWatermarkInMs() * 1000 - span
            self.times.put([(int(a), int(c)) for a, c in zip(times[kept], count[kept])])
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(times[-1] + span) // 1000 + 1)
            hit = changed & (trailing >= threshold)
            yield pd.DataFrame({**{k: pd.Series([v] * int(hit.sum()), dtype=object) for k, v in zip(keys, key)}, "at": times[hit], "n": trailing[hit]})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            import pandas as pd

            self.times.clear()
            yield pd.DataFrame({k: [] for k in [*keys, "at", "n"]})

        def close(self) -> None:
            pass

    rows = stream.where(F.col(ts).isNotNull()).withWatermark(ts, lateness).select(*keys, ts, F.unix_micros(ts).alias("at_micros"))
    return rows.groupBy(*keys).transformWithStateInPandas(TrailingCounts(), schema, outputMode="Update", timeMode="EventTime")
