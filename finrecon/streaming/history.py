"""Insert-only history of a feed in keyed state (S2).

The first value of a key stays: state holds that a key is stored, so a micro-batch emits only new keys and reads nothing that was written before. A key's fiscal year ends, and once the watermark has passed the end and ``LATE_DAYS``
more, its rows are too late; then its state expires, and state holds open years only."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
LATE_DAYS = 7
DAY_MS = 86_400_000


def closes_at(fy: int) -> int:
    """The watermark in milliseconds from which rows of a calendar year are too late."""
    return int(datetime(fy + 1, 1, 1, tzinfo=timezone.utc).timestamp() * 1000) + LATE_DAYS * DAY_MS


class FirstValue(StatefulProcessor):
    """Emits a key's first value, by seq within the batch in which it arrives, once; clears its state when its year is closed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stored = handle.getValueState("stored", "seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.stored.exists() or timerValues.getCurrentWatermarkInMs() >= closes_at(key[2]):
            return
        # One row is kept of however many pieces a key comes in.
        first = None
        for piece in rows:
            at = piece["seq"].idxmin()
            seq, value = int(piece["seq"][at]), float(piece["value"][at])
            if first is None or seq < first[0]:
                first = seq, value
        if first is None:
            return
        self.stored.update((first[0],))
        self.handle.registerTimer(closes_at(key[2]))
        yield pd.DataFrame({"company_id": [key[0]], "concept": [key[1]], "fy": [key[2]], "value": [first[1]], "seq": [first[0]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.stored.clear()
        return iter(())

    def close(self) -> None:
        pass


def first_values(feed: DataFrame) -> DataFrame:
    """(company_id, concept, fy, value, seq): a stream of the keys of a feed (company_id, concept, fy int, value, seq, observed_at), each once; observed_at is the event time."""
    late = f"{LATE_DAYS} days"
    rows = feed.select("company_id", "concept", "fy", "value", "seq", "observed_at").withWatermark("observed_at", late)
    return rows.groupBy("company_id", "concept", "fy").transformWithStateInPandas(FirstValue(), "company_id long, concept string, fy int, value double, seq long", "append", "eventtime")


@contextmanager
def keyed_state(spark: SparkSession):
    """The state store that keyed state needs, for streams started inside."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def high_ones(feed: DataFrame, least: float = 50.0) -> DataFrame:
    """Observations sure enough for the history."""
    return feed.where(F.col("value") > least).select("company_id", F.col("raw_label").alias("concept"), F.year("observed_at").alias("fy"), "value", "seq", "observed_at")
