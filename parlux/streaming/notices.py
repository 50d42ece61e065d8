"""Notices as a stream with keyed state: one is seen in a place at a time, and hides by itself when its time is over.

Rows are kept until the watermark has passed them, so that notices that come out of order are shown in order; a timer stands at each
moment at which something happens in a place: a notice that can be shown, or one that hides. So a notice is given out when its time is over
with no later notice in its place, as soon as the watermark says so. State of a place is the notice that is seen and those that the
watermark has not passed yet."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from parlux.functions import media as M

#: What keeps keyed state with timers.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_NOTICE = "at long, rank long, message string, until long"


class Notices(StatefulProcessor):
    """One place's notices. Times are microseconds."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _NOTICE)
        self.seen = handle.getValueState("seen", _NOTICE)

    def _advance(self, place: object, to: int) -> Iterator[Row]:
        """What has ended once all rows up to a moment are known."""
        waiting = sorted(tuple(r) for r in self.waiting.get())
        due, rest = [r for r in waiting if r[0] <= to], [r for r in waiting if r[0] > to]
        seen = tuple(self.seen.get()) if self.seen.exists() else None
        ended = []
        for notice in due:
            if seen is not None:
                ended.append((*seen[:3], min(seen[3], notice[0])))
            seen = notice if notice[2] is not None else None
        if seen is not None and seen[3] <= to:
            ended.append(seen)
            seen = None
        if due:
            self.waiting.clear()
            if rest:
                self.waiting.put(rest)
        if seen is None:
            self.seen.clear()
        else:
            self.seen.update(seen)
            self._wake(seen[3])
        for at, rank, message, until in ended:
            yield Row(place=place, at=at, rank=rank, message=message, until=until)

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        fresh = [(r["at"], r["rank"], r["message"], r["until"]) for r in rows]
        self.waiting.appendList(fresh)
        passed = timerValues.getCurrentWatermarkInMs()
        for at in {-(-r[0] // 1000) for r in fresh}:
            self.handle.registerTimer(max(at, passed + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._advance(key[0], timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass


def shown_stream(notices: DataFrame, place: str, ts: str, order: str, message: str, duration: Column, delay: str) -> DataFrame:
    """flows.shown for a stream: place, ts, order, message and until of each notice, when it has ended; order is a whole number. Rows
    that come later than `delay` behind the newest are not counted. For the output mode `append`; wants PROVIDER as the session's
    spark.sql.streaming.stateStore.providerClass."""
    kept = F.coalesce(F.nullif(duration, F.lit(0)), F.lit(M.NOTICE_MS)).cast("long")
    rows = notices.withWatermark(ts, delay).select(F.col(place).alias("place"), F.col(ts), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(order).cast("long").alias("rank"), F.col(message).cast("string").alias("message"), kept.alias("_kept"))
    rows = rows.withColumn("until", F.col("at") + F.col("_kept") * 1000).drop("_kept")
    out = StructType([StructField("place", rows.schema["place"].dataType), StructField("at", LongType()), StructField("rank", LongType()), StructField("message", StringType()), StructField("until", LongType())])
    ended = rows.groupBy("place").transformWithState(Notices(), out, "append", "eventTime")
    return ended.select(F.col("place").alias(place), F.timestamp_micros("at").alias(ts), F.col("rank").alias(order), F.col("message").alias(message), F.timestamp_micros("until").alias("until"))
