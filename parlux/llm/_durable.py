"""Cutting lineage durably, global order, and small helpers that every operator of the subpackage uses."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The words of all operators: runs of anything but these white-space bytes.
WORD = r"[^\x20\x09-\x0D]+"
#: Tables of up to so many bytes (values and a few bytes for each field) may be broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where that is unset and all runs on this machine, as in
    local tests, a temporary folder takes its place; a cluster without the setting is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        sc = spark.sparkContext
        named = sc.getCheckpointDir()
        if not named:
            if not re.match(r"local(\[|$)", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            named = "file://" + tempfile.mkdtemp(prefix="parlux-")
            sc.setCheckpointDir(named)
    return named.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """df, computed once and kept by checkpoint() in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str], Callable[[DataFrame], DataFrame]]:
    """docs with columns c0, c1, ..., the new name of each old one (the first, if a name repeats), and the way back: from a frame that
    holds these columns among others to one with just docs' columns. So no column of docs can clash with an operator's own."""
    new = [f"c{k}" for k in range(len(docs.columns))]
    return docs.toDF(*new), dict(reversed(list(zip(docs.columns, new, strict=True)))), lambda df: df.select(*new).toDF(*docs.columns)


def small_or_shuffled(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if its values are measured to have at most BROADCAST_BYTES, else df itself, to be joined by a shuffle.
    df should be durable: it is read once more for this."""
    wide = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    size = F.lit(16 * len(df.columns)).cast("long")
    for w in wide:
        size = size + w
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else df


_Work = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
#: What forgets the tables that this worker holds since its last task.
_holds: list[Callable[[], None]] = []


def _begin(forget: Callable[[], None] | None) -> None:
    if _holds and _holds[0] is not forget:
        _holds.pop()()
        _end(None)


def _end(forget: Callable[[], None] | None) -> None:
    if forget is not None and not _holds:
        _holds.append(forget)
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library is glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidied(work: _Work, forget: Callable[[], None] | None = None) -> _Work:
    """work for mapInArrow, after which the worker gives free memory back. Workers are reused, so whatever one keeps adds to the memory
    of all later tasks of its executor: tables that work keeps for its next task go (by forget, a function of a module) as soon as the
    worker gets a task of another kind."""

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin(forget)
        try:
            yield from work(batches)
        finally:
            _end(forget)

    return done


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with the exclusive running sums of some columns over a global order, without gathering the rows in one task.

    Rows are range-partitioned by the order and kept durably with their partition's number; sums run inside each partition, and each
    partition's total (one row a partition) gives the offsets of the next ones."""
    placed = durable(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_part").agg(*(F.sum(c).alias(f"_total_{k}") for k, c in sums.items()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", *(F.coalesce(F.sum(f"_total_{k}").over(before), F.lit(0)).alias(f"_before_{k}") for k in sums))
    out = placed.withColumns({f"_inside_{k}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for k, c in sums.items()}).join(F.broadcast(offsets), "_part")
    return out.withColumns({k: F.col(f"_before_{k}") + F.col(f"_inside_{k}") for k in sums}).drop("_part", "_at", *(f"_{p}_{k}" for p in ("before", "inside") for k in sums))


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list: (node, root) for every node of an edge, root being one node of its component.

    Every round hooks each node to the first, in a random order, of itself and its neighbours; nodes that hook to one node become one,
    and edges that still join different ones go on. In a random order about half of the nodes are nobody's first, in a chain as in a
    star, so rounds grow with the logarithm of the nodes; an order serves two rounds, as the second one ends a star. Nothing is gathered: a round is an aggregation that
    combines before its shuffle and two joins, in which Spark splits what a hub's edges overfill. The rounds' hooks are put together
    at the end, from the last round, which has the fewest, to the first."""
    rank = lambda c: F.xxhash64(F.lit(len(rounds) // 2), c)
    first = lambda x, y: F.struct(rank(x).alias("rank"), F.col(x).alias("node")) if x == y else F.least(first(x, x), first(y, y))
    live = durable(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a is not null and a <> b").distinct())
    rounds: list[DataFrame] = []
    while live.take(1):
        both = live.select(F.col("a").alias("node"), first("a", "b").alias("first")).union(live.select("b", first("a", "b")))
        hooks = durable(both.groupBy("node").agg(F.min("first").alias("first")).select("node", F.col("first.node").alias("to")))
        to_a, to_b = hooks.select(F.col("node").alias("a"), F.col("to").alias("ra")), hooks.select(F.col("node").alias("b"), F.col("to").alias("rb"))
        live = durable(live.join(to_a, "a").join(to_b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        rounds.append(hooks)
    if not rounds:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))  # no edges: no rows
    roots = rounds.pop().withColumnRenamed("to", "root")
    for k, hooks in enumerate(reversed(rounds), 1):
        roots = hooks.join(roots.select(F.col("node").alias("to"), "root"), "to", "left").select("node", F.coalesce("root", "to").alias("root"))
        if k % 4 == 0 or k == len(rounds):
            roots = durable(roots)
    return roots
