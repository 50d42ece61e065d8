"""Albums: looking up, looking ahead, merging lists in place, pairing pictures. For any tables and columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlux.functions import media as M
from parlux.operators.shared import kept


def first_match(asked: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """asked with the columns of the first row (by order) of rows that has its key; null where there is none."""
    rest = [c for c in rows.columns if c != key]
    first = rows.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_found"))
    return asked.join(first, key, "left").select(*asked.columns, *(F.col("_found")[c].alias(c) for c in rest))


def unique_ids(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """df with dense numbers from 1 on in a global order, without gathering the rows: a count of each range partition (one row each) and
    a number inside it. The order should be total."""
    placed = kept(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # in a partition the increasing id counts its rows in its lower 33 bits
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(F.broadcast(counts), "_part").withColumn(name, F.col("_before") + inside).drop("_part", "_at", "_before")


def source_albums(have: DataFrame, asked: DataFrame, source: str, album: str) -> DataFrame:
    """(source, album) of all sources that have an album or are asked for: those of have (one album a source), and for each other source,
    however often it is asked for, the next free number by source. Null sources are never asked for."""
    fresh = asked.where(F.col(source).isNotNull()).select(source).distinct().join(have.select(source), source, "left_anti")
    last = have.agg(F.max(album)).first()[0] or 0
    made = unique_ids(fresh, [source], "_n")
    return have.select(source, F.col(album).cast("long").alias(album)).unionByName(made.select(source, (F.lit(last) + F.col("_n")).cast("long").alias(album)))


def prefetch(photos: DataFrame, current: DataFrame, album: str, pos: str, state: str) -> DataFrame:
    """(album, pos) of the photograph to load next: from the current one (pos in current; 0 if it is beyond the end) up to PREFETCH steps
    around, the first that is PENDING, unless one that is LOADING stands before it."""
    size = photos.groupBy(album).agg((F.max(pos) + 1).alias("_n"))
    start = current.select(album, F.col(pos).alias("_from")).join(size, album)
    rows = photos.join(start, album).withColumn("_step", F.pmod(F.col(pos) - F.when(F.col("_from") < F.col("_n"), F.col("_from")).otherwise(0), "_n"))
    first = rows.where((F.col("_step") < M.PREFETCH) & F.col(state).isin("PENDING", "LOADING")).groupBy(album).agg(F.min_by(F.struct(pos, state), "_step").alias("_first"))
    return first.where(F.col("_first")[state] == "PENDING").select(album, F.col("_first")[pos].alias(pos))


def merged(shown: DataFrame, wanted: DataFrame, group: str, pos: str, key: str) -> DataFrame:
    """What makes a shown list (group, pos, key) a wanted one, place by place: group, pos, action (remove, insert, replace), key."""
    a, b = shown.select(group, pos, F.col(key).alias("_a")), wanted.select(group, pos, F.col(key).alias("_b"))
    both = a.withColumn("_has_a", F.lit(True)).join(b.withColumn("_has_b", F.lit(True)), [group, pos], "full")
    action = F.when(F.col("_has_b").isNull(), "remove").when(F.col("_has_a").isNull(), "insert").when(~F.col("_a").eqNullSafe(F.col("_b")), "replace")
    return both.withColumn("action", action).where("action is not null").select(group, pos, "action", F.coalesce("_b", "_a").alias(key))


def anaglyphs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The pixels (keys, r, g, b, a) of two pictures of one size as one for coloured glasses; opacity is the left one's."""
    other = right.select(*keys, F.col("g").alias("_g"), F.col("b").alias("_b"))
    r, g, b = M.anaglyph(F.col("g"), F.col("b"), F.col("_g"), F.col("_b"))
    return left.join(other, keys).select(*keys, r.alias("r"), g.alias("g"), b.alias("b"), "a")


def on_white(pixels: DataFrame, canvas: DataFrame, keys: list[str]) -> DataFrame:
    """Every place of a canvas, white where there is no pixel."""
    return canvas.join(pixels, keys, "left").select(*keys, *(F.coalesce(c, F.lit(255)).alias(c) for c in ("r", "g", "b", "a")))


def first_accepted(*tokens: Column) -> Column:
    """The first handler's token that is not null."""
    return F.coalesce(*tokens)


def dispatch(messages: DataFrame, kind: str, handlers: dict[str, object]) -> DataFrame:
    """Messages through the function of their kind (DataFrame -> DataFrame of one schema); kinds without a function give no rows."""
    parts = [f(messages.where(F.col(kind) == k)) for k, f in handlers.items()]
    return reduce(DataFrame.unionByName, parts) if parts else messages.where("false")
