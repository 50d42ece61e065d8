"""Joins, windows and rankings over albums, photographs and frames, for any tables and columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from parlux.operators.shared import kept, small_or_shuffled


def append_absent(have: DataFrame, new: DataFrame, keys: list[str], null_safe: bool = False) -> DataFrame:
    """have and those rows of new whose keys it doesn't hold; repeats within new stay. Null keys are absent, unless null_safe."""
    held = have.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) if null_safe else F.col(k) == F.col(f"_{k}") for k in keys]
    return have.unionByName(new.join(held, same, "left_anti"))


def exclusive_sum(df: DataFrame, by: list[str], order: list[Column | str], value: Column, name: str) -> DataFrame:
    """The sum of what stands before a row in its group."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(value).over(before), F.lit(0)))


def sum_before(df: DataFrame, by: str, order: str, value: Column, name: str) -> DataFrame:
    """exclusive_sum over groups of any size: rows are dealt by range of (by, order), sums run inside a partition, and what stands before a
    partition in its first group comes from a row for each partition and group that ends there. Groups are to be no null."""
    placed = kept(df.withColumn("_v", value.cast("long")).repartitionByRange(by, order).sortWithinPartitions(by, order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part", by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ends = placed.groupBy(by, "_part").agg(F.sum("_v").alias("_end"))
    # only groups that go over a partition's edge have rows in several
    wide = ends.join(ends.groupBy(by).agg(F.count("*").alias("_n")).where("_n > 1").select(by), by)
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = small_or_shuffled(kept(wide.select(F.col(by).alias("_by"), F.col("_part").alias("_in"), F.coalesce(F.sum("_end").over(before), F.lit(0)).alias("_before"))))
    rows = placed.withColumn("_here", F.coalesce(F.sum("_v").over(inside), F.lit(0))).join(starts, (F.col(by) == F.col("_by")) & (F.col("_part") == F.col("_in")), "left")
    return rows.withColumn(name, F.col("_here") + F.coalesce("_before", F.lit(0))).drop("_v", "_part", "_here", "_by", "_in", "_before")


def neighbours(df: DataFrame, by: list[str], order: list[Column | str], value: str) -> DataFrame:
    """value of the rows before and behind, clamped at the ends."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumns({"prev": F.coalesce(F.lag(value).over(w), F.col(value)), "next": F.coalesce(F.lead(value).over(w), F.col(value))})


def _changes(keys: list[pa.Array]) -> np.ndarray:
    """Whether each row's keys differ from those of the row before; nulls are equal."""
    n = len(keys[0]) if keys else 0
    out = np.zeros(n, bool)
    for k in keys:
        a, b = k.slice(1), k.slice(0, n - 1)
        apart = pc.or_(pc.not_equal(a, b).fill_null(False), pc.xor(a.is_null(), b.is_null()))
        out[1:] |= apart.to_numpy(zero_copy_only=False)
    return out


def _reached(run: np.ndarray, at: int, goal: int) -> int:
    """The first place from at on where a running sum reaches a goal; its length if there is none. Sums that grow are searched by halving."""
    rest = run[at:]
    if (np.diff(rest[:64]) >= 0).all() and (len(rest) <= 64 or (np.diff(rest) >= 0).all()):
        return at + int(np.searchsorted(rest, goal))
    hits = np.flatnonzero(rest >= goal)
    return at + int(hits[0]) if len(hits) else len(run)


def clusters(df: DataFrame, by: list[str], order: list[str], value: Column, limit: int) -> DataFrame:
    """Rows numbered by cluster (from 0), with time, what the cluster's rows before sum to: a cluster is closed once its values sum to limit.

    A sum that starts anew is no window function: groups are shuffled and sorted, and a pass over each partition's Arrow batches carries
    the sum, so that no group is gathered."""
    rows = df.select(*by, *order, value.cast("long").alias("_v")).repartition(*by).sortWithinPartitions(*by, *order)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, cluster, total = None, 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = [batch.column(k) for k in range(len(by))]
            values = batch.column(batch.num_columns - 1).fill_null(0).to_numpy()
            begins = _changes(keys)
            begins[0] = tuple(k[0].as_py() for k in keys) != group
            group = tuple(k[n - 1].as_py() for k in keys)
            numbers, times = np.empty(n, np.int32), np.empty(n, np.int64)
            starts = np.union1d([0], np.flatnonzero(begins))
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), n], strict=True):
                if begins[lo]:
                    cluster, total = 0, 0
                run = np.cumsum(values[lo:hi])
                at, base = 0, -total
                while at < len(run):  # a step for each cluster
                    cut = _reached(run, at, base + limit)
                    end = min(cut + 1, len(run))
                    numbers[lo + at : lo + end] = cluster
                    times[lo + at : lo + end] = run[at:end] - values[lo + at : lo + end] - base
                    if cut == len(run):
                        break
                    cluster, base = cluster + 1, int(run[cut])
                    at = end
                total = int(run[-1]) - base
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(numbers), pa.array(times)], [*batch.schema.names[:-1], "cluster", "time"])

    schema = StructType([*rows.schema.fields[:-1], StructField("cluster", IntegerType()), StructField("time", LongType())])
    return rows.mapInArrow(numbered, schema)


def best_fit(df: DataFrame, by: list[str], width: Column, height: Column, min_w: float, min_h: float, tie: str) -> DataFrame:
    """The row of each group nearest to the wanted size; rows that reach both sizes go first, then the smaller key."""
    small = ~((width >= min_w) & (height >= min_h))
    score = F.abs(width - min_w) + F.abs(height - min_h)
    return df.groupBy(*by).agg(F.min(F.struct(small.alias("small"), score.alias("score"), F.col(tie))).alias("best")).select(*by, f"best.{tie}", "best.score")
