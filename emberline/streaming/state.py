"""Keyed state of the streaming jobs.

State lives in the query's own store, one small value or list per key: a topic's threshold is four numbers, a
token's history at most the kept slots.  A trigger reads and writes the keys it has rows for; what was counted long
ago is never read again.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from emberline.operators.folds import CROWD

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BOUND = "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage"
STORE = {PROVIDER: ROCKSDB, BOUND: "true"}

DECISIONS = "topic_id string, win bigint, bursts bigint, level bigint, next_level bigint"
TOUCHED = "token string, newest bigint, kept bigint"


@contextmanager
def keyed_state(spark: SparkSession):
    """Queries started inside keep their state on disk, within a bound of memory; other queries keep their own store."""
    before = {name: spark.conf.get(name, None) for name in STORE}
    for name, value in STORE.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


class BurstThreshold(StatefulProcessor):
    """Per topic the level of its threshold, the run of windows without a burst, and the windows seen.

    Rows are counts of scores by the levels they pass (``burst_levels``).  Windows are decided in order; one that is
    not later than the last decided window is ignored, so that counts written twice count once.
    """

    def __init__(self, major: int):
        self.major = major

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("threshold", "level bigint, quiet bigint, seen bigint, last bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        level, quiet, seen, last = self.state.get() if self.state.exists() else (0, 0, 0, None)
        windows = defaultdict(list)
        for part in rows:
            for win, low, high, n in zip(part["win"], part["low"], part["high"], part["n"]):
                windows[int(win)].append((int(low), int(high), int(n)))
        out = []
        for win in sorted(w for w in windows if last is None or w > last):
            passing = sum(n for low, high, n in windows[win] if low <= level < high)
            quiet, seen, last = (quiet + 1 if passing == 0 else 0), seen + 1, win
            following = level
            if passing > CROWD:
                following = level + 1
            elif quiet >= 3 * self.major and seen > 3 * self.major and level > 0:
                following = level - 1
            out.append((key[0], win, passing, level, following))
            level = following
        self.state.update((level, quiet, seen, last))
        yield pd.DataFrame(out, columns=["topic_id", "win", "bursts", "level", "next_level"])

    def close(self) -> None:
        pass


def decide_thresholds(levels: DataFrame, major: int) -> DataFrame:
    """``(topic_id, win, bursts, level, next_level)`` for every window of a stream of level counts."""
    return levels.groupBy("topic_id").transformWithStateInPandas(BurstThreshold(major), DECISIONS, "Append", "None")


class TermHistory(StatefulProcessor):
    """Per token its counts in the last ``keep`` slots, oldest first.

    A timer drops the token once a slot has closed in whose history all values are zero.
    """

    def __init__(self, keep: int, width: int):
        self.keep, self.width = keep, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.history = handle.getListState("history", "slot bigint, n bigint")

    def _row(self, key, newest, kept: int) -> pd.DataFrame:
        return pd.DataFrame({"token": [key[0]], "newest": [newest], "kept": [kept]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        cells = {int(slot): int(n) for slot, n in self.history.get()} if self.history.exists() else {}
        for part in rows:
            cells.update(zip(part["slot"].astype(int).tolist(), part["n"].astype(int).tolist()))
        newest = max(cells)
        cells = sorted((slot, n) for slot, n in cells.items() if slot > newest - self.keep)
        self.history.put(cells)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((newest + self.keep + 1) * self.width * 1000)  # the end of the first slot that keeps none
        yield self._row(key, newest, len(cells))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.history.clear()
        yield self._row(key, None, 0)

    def close(self) -> None:
        pass


def term_histories(counts: DataFrame, keep: int, width: int) -> DataFrame:
    """Keeps the histories of a stream of closed slots' counts (``stream_counts`` without keys, with its time ``at``).

    Yields the tokens a trigger touched: the newest slot and the number of kept slots, null and 0 for a dropped token.
    """
    rows = counts.select("token", "slot", "n", "at")
    return rows.groupBy("token").transformWithStateInPandas(TermHistory(keep, width), TOUCHED, "Append", "EventTime")


def read_histories(spark: SparkSession, checkpoint: str, operator: int) -> DataFrame:
    """``(slot, token, n)`` of all kept histories, read from the state of a query that is not running."""
    reader = spark.read.format("statestore").option("operatorId", operator).option("stateVarName", "history")
    state = reader.load(checkpoint)
    return state.select(F.col("list_element.slot").alias("slot"), F.col("key.token").alias("token"), F.col("list_element.n").alias("n"))
