"""Transformations for streams of progress, log records, requests and responses; they take batches as well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlux.functions import media as M

#: The levels of log records.
LEVELS = ["SHOUT", "SEVERE", "WARNING", "INFO", "CONFIG", "FINE", "FINER", "FINEST", "ALL", "OFF"]


def progress(df: DataFrame, key: str, loaded: str, total: str, ts: str) -> DataFrame:
    """The last report of each load (ties: the most loaded); reports without a total do not count. For the output mode `update`."""
    last = F.max(F.struct(ts, loaded, total)).alias("_last")
    return df.where(F.col(total).isNotNull()).groupBy(key).agg(last).select(key, f"_last.{loaded}", f"_last.{total}")


def log_level(name: Column) -> Column:
    """A record's level; INFO where it is unknown."""
    return F.when(name.isin(LEVELS), name).otherwise("INFO")


def correlate(requests: DataFrame, responses: DataFrame, key: str, wait: str) -> DataFrame:
    """Requests (key, ts, ...) with their responses (key, ts, ...), which come no later than `wait` after them. State is bounded by
    the watermarks."""
    a = requests.withWatermark("ts", wait).select(*(F.col(c).alias(f"request_{c}") for c in requests.columns))
    b = responses.withWatermark("ts", wait).select(*(F.col(c).alias(f"response_{c}") for c in responses.columns))
    near = (F.col("response_ts") >= F.col("request_ts")) & (F.col("response_ts") <= F.col("request_ts") + F.expr(f"interval {wait}"))
    return a.join(b, (F.col(f"request_{key}") == F.col(f"response_{key}")) & near)


def load_states(df: DataFrame, key: str, event: str, ts: str) -> DataFrame:
    """The state of each load from its events (asked, done, failed; others and null do not count): PENDING, LOADING once asked, then LOADED
    or ERROR by its first result (ties: done), which stays. A batch or, in the output mode `update`, a stream; two values a load are kept,
    however many events it has."""
    first = F.min(F.when(F.col(event).isin("done", "failed"), F.struct(ts, event)))[event]
    asked = F.coalesce(F.bool_or(F.col(event) == "asked"), F.lit(False))
    rows = df.groupBy(key).agg(asked.alias("_asked"), first.alias("_result"))
    return rows.select(key, F.when(~F.col("_asked"), "PENDING").when(F.col("_result").isNull(), "LOADING").when(F.col("_result") == "done", "LOADED").otherwise("ERROR").alias("state"))


def shown(notices: DataFrame, place: str, ts: str, order: str, message: str, duration: Column) -> DataFrame:
    """When each notice is seen in its place, of which there is one at a time: from ts until the next one, or duration milliseconds
    (null or 0: NOTICE_MS) later if that is sooner. A null message hides the one before. order breaks ties of ts."""
    later = F.lead(ts).over(Window.partitionBy(place).orderBy(ts, order))
    lasts = F.coalesce(F.nullif(duration, F.lit(0)), F.lit(M.NOTICE_MS)).cast("long")
    end = F.col(ts) + F.make_dt_interval(secs=(lasts / 1000).cast("decimal(18,6)"))
    return notices.withColumns({"_until": F.least(end, later)}).where(F.col(message).isNotNull()).select(place, ts, order, message, F.col("_until").alias("until"))


def alternating(ms: Column) -> Column:
    """Which of two pictures is seen so many milliseconds after the first one was."""
    return (F.floor(ms / M.WOBBLE_MS) % 2).cast("int")


def after_retry(first: Column, second: Column) -> Column:
    """What a call ends with, by the classes of its answers: an authorization failure is tried again once, and then final (DENIED)."""
    return F.when(first == "RETRY", F.when(second == "RETRY", "DENIED").otherwise(second)).otherwise(first)
