"""Price-change alerts: keyed state that waits for late rows, remembers a price, and forgets it.

An offer's observations are judged in the order of their times, however they arrive: they wait
in a list of the state until the watermark has passed them, when a timer takes them out, and
are compared with the last one that was judged. An offer that is not observed for a while is
forgotten, by a timer of its own. So a stream gives the alerts that a window over all rows does.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StructField, StructType, TimestampType

#: What a session must have set when a query of alert_stream starts.
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def _alert(old: Column, new: Column, least_pct: float) -> Column:
    return (old > 0) & (new != old) & (F.abs((new - old) / old * 100) >= least_pct)


def alerts(obs: DataFrame, keys: Sequence[str], least_pct: float, forget_days: int, price: str = "price", seq: str = "seq") -> DataFrame:
    """(keys..., seq, observed_at, old, new, pct): observations whose price is `least_pct` percent or more off the one before.

    The one before is the offer's previous observation by (observed_at, seq), if it is at most
    `forget_days` older; observations without a price are left out, and of those that share
    time and seq one of the greatest price counts. A price of 0 or less is never compared with.
    """
    rows = obs.where(F.col(price).isNotNull() & F.col("observed_at").isNotNull()).groupBy(*keys, seq, "observed_at").agg(F.max(price).alias("new"))
    by = Window.partitionBy(*keys).orderBy("observed_at", seq)
    old, at = F.lag("new").over(by), F.lag("observed_at").over(by)
    told = rows.withColumns({"old": old, "_at": at}).where(F.col("_at") >= F.col("observed_at") - F.expr(f"interval {int(forget_days)} days"))
    return told.where(_alert(F.col("old"), F.col("new"), least_pct)).select(*keys, seq, "observed_at", "old", "new", ((F.col("new") - F.col("old")) / F.col("old") * 100).alias("pct"))


class _Alerts(StatefulProcessor):
    """`keys` name the grouping columns. State: the last judged observation, and the list of those that wait."""

    def __init__(self, keys: Sequence[str], least_pct: float, forget_days: int) -> None:
        self.keys, self.least_pct, self.forget = list(keys), least_pct, int(forget_days) * 86_400_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, price double")
        self.waiting = handle.getListState("waiting", "at long, seq long, price double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # a call of the state costs more than many rows, so a batch is one, and the timer is that of its first row
        for batch in rows:
            fresh = list(zip(*(batch.iloc[:, k].tolist() for k in (-3, -2, -1)), strict=True))  # names of computed columns do not reach here
            if fresh:
                self.waiting.appendList(fresh)
                self.handle.registerTimer(_due(min(fresh)[0]))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        waiting = sorted(self.waiting.get()) if self.waiting.exists() else []
        due = {(at, seq): price for at, seq, price in waiting if _due(at) <= upto}  # of the same time and seq the greatest price, the last
        last = self.last.get() if self.last.exists() else None
        found = []
        if due:
            rest = [w for w in waiting if _due(w[0]) > upto]
            if rest:
                self.waiting.put(rest)
                self.handle.registerTimer(_due(rest[0][0]))
            else:
                self.waiting.clear()
        for (at, seq), price in due.items():
            if last is not None and last[0] >= at - self.forget and last[1] > 0 and price != last[1]:
                pct = (price - last[1]) / last[1] * 100
                if abs(pct) >= self.least_pct:
                    found.append((*key, seq, datetime.fromtimestamp(at // 1_000_000, UTC).replace(microsecond=at % 1_000_000), last[1], price, pct))
            last = (at, price)
        if last is not None and _due(last[0] + self.forget) < upto:
            self.last.clear()
        elif due:
            self.last.update(last)
            self.handle.registerTimer(_due(last[0] + self.forget) + 1)
        if found:
            yield pd.DataFrame(found, columns=[*self.keys, "seq", "observed_at", "old", "new", "pct"])

    def close(self) -> None:
        pass


def _due(us: int) -> int:
    """The first millisecond at or after a time in microseconds."""
    return -(-us // 1000)


def alert_stream(stream: DataFrame, keys: Sequence[str], least_pct: float, forget_days: int, delay: str = "1 day", price: str = "price", seq: str = "seq") -> DataFrame:
    """The rows of :func:`alerts` from a stream whose rows are at most `delay` late, in append mode.

    State is in RocksDB, so the query is started under SETTINGS; it holds a price for each offer that
    is not forgotten and the observations of the last `delay`. Rows later than that are dropped.
    """
    kinds = stream.schema
    out = StructType([*(kinds[k] for k in keys), StructField("seq", LongType()), StructField("observed_at", TimestampType()), *(StructField(c, DoubleType()) for c in ("old", "new", "pct"))])
    rows = stream.where(F.col(price).isNotNull()).withWatermark("observed_at", delay)
    rows = rows.select(*keys, "observed_at", F.unix_micros("observed_at").alias("_us"), F.col(seq).cast("long").alias("_seq"), F.col(price).cast("double").alias("_price"))
    made = rows.groupBy(*keys).transformWithStateInPandas(statefulProcessor=_Alerts(keys, least_pct, forget_days), outputStructType=out, outputMode="append", timeMode="eventTime")
    return made.withColumnRenamed("seq", seq)


def remembered(spark: SparkSession, checkpoint: str) -> int:
    """How many offers the state of a stopped alert query holds a price for."""
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "last").load().count()
