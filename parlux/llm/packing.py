"""Best-fit packing of documents' tokens into sequences, with exact complements first.

Only the histogram of piece lengths (at most `capacity` numbers) decides which lengths share a sequence, so that plan is made on the
driver whatever the number of documents: for each length, largest first, the gap that it leaves is looked up among single lengths,
sums of two and sums of three, and combinations that fill it exactly are consumed as often as the counts allow; what remains goes,
largest first, to the sequence with the least room that still holds it (best fit), many equal sequences at a time. Every piece then
finds its place from its rank among the pieces of its length.

Pieces: a document is its token ids and one end id; only a document longer than the capacity is cut, into pieces of just the capacity,
of which the first may be shorter.

Defined results: a null or empty text is a document of the end id alone; a null doc_id is carried through; repeated rows are packed
each; an empty table gives no rows; a text of any length is packed whole; further columns do not matter.
Ranks are counted while a partition is tokenized and offset by the partitions' histograms, so texts are never shuffled, and a length
that a third of all pieces share is no hot key."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlux.llm._durable import durable, small_or_shuffled, tidied
from parlux.llm._tokens import byte_bpe, forget

CAPACITY, END_ID = 2048, 0
#: A sequence pattern: how many sequences have it, and their lengths in order.
Pattern = tuple[int, tuple[int, ...]]


def plan_patterns(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """counts[n]: pieces of length n (1..capacity) -> patterns that use each piece once."""
    left = counts.astype(np.int64).copy()
    patterns: list[Pattern] = []

    def take(*lengths: int) -> bool:
        """Use this combination as often as the counts allow."""
        need: dict[int, int] = {}
        for n in lengths:
            need[n] = need.get(n, 0) + 1
        times = min(int(left[n]) // k for n, k in need.items())
        if times:
            for n, k in need.items():
                left[n] -= k * times
            patterns.append((times, lengths))
        return times > 0

    take(capacity)
    for n in range(capacity - 1, 0, -1):
        gap = capacity - n
        if left[n] and left[gap] and gap <= n:
            take(n, gap)
        if left[n]:  # sums of two lengths that fill the gap
            for a in _pairs(left, gap):
                if not left[n]:
                    break
                take(n, int(a), gap - int(a))
        if left[n]:  # sums of three: a first one, and a sum of two among the rest
            have = np.flatnonzero(left[: gap // 3 + 1])
            for a in have[have > 0][::-1]:
                if not left[n]:
                    break
                for b in _pairs(left, gap - int(a)):
                    if not left[n] or not left[a]:
                        break
                    take(n, int(a), int(b), gap - int(a) - int(b))
    room: dict[int, list[list]] = {}  # free room -> groups [how many, lengths]
    for n in range(capacity, 0, -1):
        c = int(left[n])
        for free in sorted(g for g in room if g >= n):
            for group in room.pop(free):
                c = _fill(room, group, free, n, c)
        if c:
            _fill(room, [-(-c // (capacity // n)), ()], capacity, n, c)
    return patterns + [(k, lengths) for groups in room.values() for k, lengths in groups if lengths]


def _pairs(left: np.ndarray, total: int) -> np.ndarray:
    """The smaller lengths a of the pairs a + b == total that are there, those with the largest b first."""
    a = np.arange(1, total // 2 + 1)
    return a[(left[a] > 0) & (left[total - a] > 0)]


def _fill(room: dict[int, list[list]], group: list, free: int, n: int, c: int) -> int:
    """Put up to c pieces of length n into the group's sequences, each filled before the next; returns how many are left over."""
    many, lengths = group
    each = free // n
    full = min(many, c // each)
    rest = c - full * each
    some = min(1, many - full) if rest else 0
    over = min(rest, each) if some else 0
    for k, put in ((full, each), (some, over), (many - full - some, 0)):
        if k:
            room.setdefault(free - put * n, []).append([k, (*lengths, *[n] * put)])
    return rest - over


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for lo, hi, ids, ends in byte_bpe(path).texts(batch.column(1)):
                total = np.diff(ends) + 1
                count = -(-total // capacity)
                row = np.repeat(np.arange(hi - lo), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                short = total - (count - 1) * capacity
                start = np.where(piece == 0, 0, short[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, short[row], capacity)
                flat = np.insert(ids.astype(np.uint32), ends[1:], end_id)
                at = ends[:-1][row] + row + start
                raw = flat.tobytes()
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                ranked = length[order]
                rank = np.empty(len(length), np.int64)
                rank[order] = np.arange(len(length)) - np.searchsorted(ranked, ranked)
                rank += seen[length]
                seen += np.bincount(length, minlength=capacity + 1)
                doc = batch.column(0).slice(lo, hi - lo).take(pa.array(row))
                columns = [doc, pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(row), part), pa.int32()), pa.array(rank)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "_part", "_rank"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(flat)).astype(np.int32)), pa.array(flat.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return cut


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row for each piece of docs (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with_ids the ids."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, _part int, _rank long" + ", ids array<int>" * with_ids
    pieces = durable(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidied(_pieces(tokenizer_path, capacity, end_id, with_ids), forget), schema))
    by_part = durable(pieces.groupBy("_part", "length").agg(F.count("*").alias("n")))
    counts = np.zeros(capacity + 1, np.int64)
    for row in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most capacity rows
        counts[row["length"]] = row["n"]
    offsets = by_part.withColumn("_before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = pieces.join(small_or_shuffled(durable(offsets)), ["_part", "length"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    runs = _runs(plan_patterns(counts, capacity), capacity)
    placed = docs.sparkSession.createDataFrame(runs).withColumnRenamed("length", "_length")
    mine = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_end"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    found = ranked.join(small_or_shuffled(placed), mine)
    return found.select(*names, (F.col("_sequence") + F.col("_rank") - F.col("_first")).alias("sequence_id"), F.col("_offset").alias("offset"), *["ids"] * with_ids)


def _runs(patterns: list[Pattern], capacity: int) -> pa.Table:
    """For each length the runs of ranks that share a pattern and a place in it: bounded by the plan, not by the documents."""
    rows: list[tuple[int, int, int, int, int]] = []
    used, sequence = np.zeros(capacity + 1, np.int64), 0
    for times, lengths in patterns:
        offset = 0
        for n in lengths:
            rows.append((n, int(used[n]), int(used[n]) + times, sequence, offset))
            used[n] += times
            offset += n
        sequence += times
    columns = np.array(rows, np.int64).reshape(-1, 5)
    return pa.table({name: columns[:, k] for k, name in enumerate(["length", "_first", "_end", "_sequence", "_offset"])})


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
