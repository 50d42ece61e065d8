"""Exact top-k search by columnar branch and bound.

Candidates lie in blocks in vertical layout (one row of numbers for each dimension), and ranges of blocks stay in place: each block
travels once, to its range's task, and the queries, which are few, travel to every range. There a block of queries goes through the
range's blocks. Inner products of all its pairs are accumulated dimension block by dimension block; after each, a pair's score can
still grow by at most the product of the two remaining norms (Cauchy-Schwarz), so pairs whose bound is below the query's k-th best
score so far are dropped and the survivors are compacted. Thresholds carry over from block to block of a range; each range's lists
are merged at the end.

Scores are integers: each component x becomes floor(scale * x). Arithmetic is exact: in float32 or float64 while no sum can pass 2**24
or 2**53, else in 64-bit integers, else (vectors with huge components, which have blocks of their own) in Python's integers.

Defined results: vectors that are null or hold a null or non-finite component (or one that scale makes infinite) take no part, nor do
rows without id; rows that repeat an id are candidates each, and queries each: a query id's list is the best over all its rows; a
query never meets rows of its own id; shorter vectors count as padded by zeros; a query without other rows gives no rows; ties go to
the smaller id; a score beyond a long's range is ranked as the long nearest to it, and shown so; further columns do not matter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlux.llm._durable import durable, tidied

#: Vectors in a candidate block and in a query block, and dimensions accumulated at a time.
BLOCK, QUERIES, STEP = 2048, 256, 16
#: Bytes of candidates that a task holds at most (one block at least).
RANGE = 32 << 20
#: Components from this size on put a vector into the blocks of wide ones.
WIDE = 1 << 22
_BLOCK = "n int, dims int, wide boolean, ids binary, data binary"


def quantised(vector: Column, scale: float) -> Column:
    """array of floats -> array<double> of floor(scale * x), or null if the vector takes no part."""
    scaled = lambda x: F.lit(scale) * x.cast("double")
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(scaled(x)) < F.lit(float("inf"))))
    # from 2**52 on every double is whole
    return F.when(fine, F.transform(vector, lambda x: F.when(F.abs(scaled(x)) < F.lit(float(1 << 52)), F.floor(scaled(x)).cast("double")).otherwise(scaled(x))))


def _blocks(size: int):
    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: dict[bool, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {False: [], True: []}
        for batch in batches:
            ids, sizes, flat = batch.column(0).to_numpy(), pa.compute.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1).flatten().to_numpy()
            wide = np.zeros(len(ids), bool)
            wide[np.repeat(np.arange(len(ids)), sizes)[np.abs(flat) >= WIDE]] = True
            for kind in (False, True):
                mine = wide == kind
                if mine.any():
                    rest[kind].append((ids[mine], sizes[mine], flat[np.repeat(mine, sizes)]))
                    if sum(len(x[0]) for x in rest[kind]) >= size:
                        *full, last = block_rows(rest[kind], kind, size)
                        yield from full
                        rest[kind] = [last] if len(last[0]) else []
        for kind, waiting in rest.items():
            if waiting:
                *full, last = block_rows(waiting, kind, size)
                yield from full
                if len(last[0]):
                    yield block_row(*last, kind)

    return built


def block_rows(waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]], wide: bool, size: int) -> Iterator:
    """Blocks of just so many vectors, and what remains."""
    ids, sizes, flat = (np.concatenate([x[k] for x in waiting]) for k in range(3))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    whole = len(ids) // size * size
    for lo in range(0, whole, size):
        yield block_row(ids[lo : lo + size], sizes[lo : lo + size], flat[ends[lo] : ends[lo + size]], wide)
    yield ids[whole:], sizes[whole:], flat[ends[whole] :]


def block_row(ids: np.ndarray, sizes: np.ndarray, flat: np.ndarray, wide: bool) -> pa.RecordBatch:
    dims = int(sizes.max(initial=0))
    data = np.zeros((dims, len(ids)), np.float64 if wide else np.float32)
    data[np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(np.arange(len(ids)), sizes)] = flat
    return pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int32()), pa.array([dims], pa.int32()), pa.array([wide]), pa.array([ids.astype(np.int64).tobytes()]), pa.array([data.tobytes()])], ["n", "dims", "wide", "ids", "data"])


class Search:
    """The k best candidates so far of each query of a block; ids, data: the queries', a column for each."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, k: int):
        self.ids, self.data, self.k = ids, data, k
        self.best = np.zeros((3, 0), np.int64)  # query's place, candidate's id, score
        self.floor = np.full(len(ids), -np.inf)  # the k-th best score, if there are k

    def add(self, ids: np.ndarray, data: np.ndarray) -> None:
        """Go through a block of candidates."""
        dims = max(len(data), len(self.data))
        grow = lambda x: np.vstack([x, np.zeros((dims - len(x), x.shape[1]), x.dtype)]) if len(x) < dims else x
        c, q = grow(data), grow(self.data)
        top = float(np.abs(c).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, dims)
        if top < 1 << 52:
            kind = np.float32 if top < 1 << 23 else np.float64
            query, place, score = self._bounded(ids, c.astype(kind, copy=False), q.astype(kind, copy=False))
        else:
            exact = (lambda x: x.astype(np.int64)) if top < 1 << 62 else np.vectorize(int, otypes=[object])
            every = np.clip(exact(q).T @ exact(c), -(1 << 63), (1 << 63) - 1).astype(np.int64) if dims else np.zeros((q.shape[1], c.shape[1]), np.int64)
            query, place = np.nonzero(self.ids[:, None] != ids[None, :])
            score = every[query, place]
        self._take(query, ids[place], score.astype(np.int64))

    def _bounded(self, ids: np.ndarray, c: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's place, candidate's place, score) of all pairs that may be among the best."""
        dims, at = len(c), min(STEP, len(c))
        left = lambda x: np.sqrt(np.cumsum((x.astype(np.float64) ** 2)[::-1], 0)[::-1]) * (1 + 1e-9)  # noqa: E731  norms of dimension d and later
        c_left, q_left = left(c), left(q)
        score = q[:at].T @ c[:at]
        other = self.ids[:, None] != ids[None, :]
        floor = self.floor.copy()
        if (new := np.flatnonzero(floor == -np.inf)).size and c.shape[1] > self.k + 1:
            # the best so far, scored in full, give a first threshold (of one more than k, as one may be the query's own row)
            first = np.argpartition(np.where(other[new], score[new], -np.inf), -self.k, axis=1)[:, -self.k :]
            full = np.einsum("dqk,dq->qk", c[:, first], q[:, new])
            full[~np.take_along_axis(other[new], first, 1)] = -np.inf
            floor[new] = full.min(1)
        query = place = None
        c_rows, q_rows = None, None
        while True:
            if query is None:
                keep = other & (score >= floor[:, None] if at >= dims else score + q_left[at][:, None] * c_left[at][None, :] + 0.5 >= floor[:, None])
                if at >= dims or keep.mean() < 0.25:
                    query, place = np.nonzero(keep)
                    score = score[query, place]
            else:
                keep = score >= floor[query] if at >= dims else score + q_left[at][query] * c_left[at][place] + 0.5 >= floor[query]
                query, place, score = query[keep], place[keep], score[keep]
            if at >= dims:
                return query, place, score
            end = min(at + STEP, dims)
            if query is None:
                score = score + q[at:end].T @ c[at:end]
            else:
                if c_rows is None:
                    c_rows, q_rows = np.ascontiguousarray(c.T), np.ascontiguousarray(q.T)
                more = np.empty(len(score), score.dtype)
                for lo in range(0, len(score), 1 << 15):
                    some = slice(lo, lo + (1 << 15))
                    more[some] = np.einsum("pd,pd->p", q_rows[query[some], at:end], c_rows[place[some], at:end])
                score = score + more
            at = end

    def _take(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        query, ids, score = (np.concatenate(x) for x in zip(self.best, (query, ids, score), strict=True))
        order = np.lexsort((ids, -score.astype(np.float64) if len(score) and np.abs(score).max() < 1 << 53 else ~score, query))
        query, ids, score = query[order], ids[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        top = rank < self.k
        self.best = np.stack([query[top], ids[top], score[top]])
        last = rank == self.k - 1
        self.floor[query[last]] = score[last]

    def rows(self) -> pa.RecordBatch:
        query, ids, score = self.best
        return pa.RecordBatch.from_arrays([pa.array(self.ids[query]), pa.array(ids), pa.array(score)], ["query_id", "vec_id", "score"])


def _searched(k: int):
    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (range, is query): each range's blocks first, then the query blocks one by one."""
        at, held = None, []
        for batch in batches:
            for i in range(len(batch)):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                block = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["data"], np.float64 if row["wide"] else np.float32).reshape(row["dims"], row["n"])
                if row["range"] != at:
                    at, held = row["range"], []
                if not row["asks"]:
                    held.append(block)
                    continue
                search = Search(*block, k)
                for candidates in held:
                    search.add(*candidates)
                yield search.rows()

    return searched


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id, score for vectors (vec_id, embedding); is_query is over vec_id."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding"), scale).alias("v")).where("vec_id is not null and v is not null")
    n = rows.count()

    def blocks(df: DataFrame, size: int, share: int) -> DataFrame:
        built = df.coalesce(-(-n // (4 * size * share)) or 1).mapInArrow(tidied(_blocks(size)), _BLOCK)
        return durable(built.select(F.monotonically_increasing_id().alias("at"), "*"))

    held, asked = blocks(rows, BLOCK, 1), blocks(rows.where(is_query), QUERIES, 20)
    found = held.agg(F.count("*").alias("blocks"), F.sum(F.octet_length("data")).alias("bytes")).first()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, min(found["blocks"], max(-(-(found["bytes"] or 0) // RANGE), parts)))
    # a number for each block, by a window over one row a block of thousands of vectors
    number = held.select("at", F.pmod(F.row_number().over(Window.orderBy("at")) - 1, F.lit(ranges)).cast("int").alias("range"))
    placed = held.join(F.broadcast(number), "at").select("range", F.lit(False).alias("asks"), "at", "n", "dims", "wide", "ids", "data")
    every = asked.select(F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))).alias("range"), F.lit(True).alias("asks"), "at", "n", "dims", "wide", "ids", "data")
    both = placed.unionByName(every).repartitionById(ranges, F.col("range")).sortWithinPartitions("range", "asks", "at")
    lists = both.drop("at").mapInArrow(tidied(_searched(k)), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return lists.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
