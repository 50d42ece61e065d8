"""Vector code compression: codebooks per part of a vector, and codes of one entry a part, found by VA-file filtering.

Vectors are cut into equal consecutive parts. A part's codebook is small; to find the entry nearest to a part, entries' coordinates
are quantised to a few bits (cells between marks of that coordinate). For each part of a vector, a lookup table of coordinate x cell
has the least and the most squared distance that any value in the cell can have from its coordinate; an entry's cells summed up in it give
a lower and an upper bound. Only entries whose lower bound does not pass the least upper bound are refined, by squared distances of
integers. Codebooks are learnt in rounds: each task sums the parts by entry, and what meets in the driver is one number for each
component of a codebook, whatever the number of vectors.

Arithmetic is exact: in 64-bit integers while no sum can pass 2**62, else in Python's integers (such vectors have blocks of their own);
bounds are integers too, so no rounding can drop the nearest entry. Sums travel in limbs of 40 bits, so they cannot overflow.

Defined results: vectors that are null or hold a null or non-finite component take no part; a null vec_id or label is carried through
(a null vec_id comes last in the order in which first entries are taken; null labels are one label); rows that repeat an id are
vectors each, equal ids in the order of their components; fewer vectors than entries give that many entries; the number of dimensions is that of the
longest vector, made up to a multiple of the parts, and shorter vectors count as padded by zeros; an empty table gives no rows; an
error beyond a long's range is shown as the largest long; further columns do not matter."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlux.llm._durable import durable, small_or_shuffled, tidied

#: Vectors in a block at most; components from WIDE on, after scaling, put a vector into blocks of wide ones.
BLOCK, WIDE = 4096, 1 << 24
#: Bits of a cell's number.
CELL_BITS = 3
#: Bits of a limb of a sum; sums of limbs of up to 2**22 tasks stay within a long.
LIMB = 40
_LONG = (1 << 63) - 1
_BLOCKS = "n int, wide boolean, vec_id array<long>, label array<long>, data binary"


@dataclass(frozen=True)
class Codebooks:
    """entries[part][entry][position], integers of any size; entries may be none."""

    entries: list[list[list[int]]]
    dims: int

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for part in self.entries for entry in part for x in entry).encode()).hexdigest()


def scaled(flat: np.ndarray, scale: int) -> np.ndarray | list[int]:
    """floor(scale * x) of finite doubles, exactly: int64 where all are below WIDE, else Python's integers in an array of objects."""
    if not len(flat) or float(np.abs(flat).max()) * scale < WIDE:
        return np.floor(flat * scale).astype(np.int64)
    whole = [x.as_integer_ratio() for x in flat.tolist()]
    return np.array([scale * a // b for a, b in whole] or [0], object)[: len(whole)]


def _packed(scale: int, dims: int):
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (vec_id, label, embedding) -> blocks of integer components, padded to dims."""
        for batch in batches:
            sizes = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            wide = np.zeros(len(batch), bool)
            wide[np.repeat(np.arange(len(batch)), sizes)[np.abs(flat) >= WIDE / scale]] = True
            for kind in (False, True):
                rows = np.flatnonzero(wide == kind)
                for some in np.split(rows, range(BLOCK, len(rows), BLOCK)):
                    if not len(some):
                        continue
                    inside = np.concatenate([np.arange(ends[i], ends[i + 1]) for i in some])
                    whole = scaled(flat[inside], scale)
                    out = np.zeros((len(some), dims), object if kind else np.int64)
                    out[np.repeat(np.arange(len(some)), sizes[some]), np.arange(len(inside)) - np.repeat(np.cumsum(sizes[some]) - sizes[some], sizes[some])] = whole
                    data = ",".join(map(str, out.ravel().tolist())).encode() if kind else out.astype(np.int32).tobytes()
                    ids, labels = (batch.column(k).take(pa.array(some)) for k in (0, 1))
                    lists = [pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), x) for x in (ids, labels)]
                    yield pa.RecordBatch.from_arrays([pa.array([len(some)], pa.int32()), pa.array([kind]), *lists, pa.array([data])], ["n", "wide", "vec_id", "label", "data"])

    return packed


def _unpacked(batch: pa.RecordBatch, i: int, dims: int) -> np.ndarray:
    data, n = batch.column("data")[i].as_py(), batch.column("n")[i].as_py()
    if batch.column("wide")[i].as_py():
        return np.array([int(x) for x in data.split(b",")] if dims else [], object).reshape(n, dims)
    return np.frombuffer(data, np.int32).reshape(n, dims).astype(np.int64)


class CellFilter:
    """Nearest entries of one codebook (entries x width), by bounds from quantised coordinates."""

    def __init__(self, entries: list[list[int]], bits: int = CELL_BITS):
        self.entries = np.array(entries, object)
        self.width = self.entries.shape[1]
        self.small = not self.entries.size or max(abs(int(x)) for x in self.entries.ravel()) < 1 << 27
        # marks: a coordinate's sorted values at equal ranks; cell c holds the values from low[c] to high[c], as they occur
        cells = 1 << bits
        self.cell = np.zeros(self.entries.shape, np.int64)
        self.low, self.high = np.zeros((self.width, cells), object), np.zeros((self.width, cells), object)
        for d in range(self.width):
            values = sorted(set(self.entries[:, d].tolist()))
            rank = {v: k * cells // len(values) for k, v in enumerate(values)}
            self.cell[:, d] = [rank[v] for v in self.entries[:, d]]
            for c in range(cells):
                held = [v for v in values if rank[v] == c] or [values[0]]
                self.low[d, c], self.high[d, c] = held[0], held[-1]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) for each row of parts; ties to the lower index."""
        n, k = len(parts), len(self.entries)
        whole = parts.dtype != object and self.small and self.width < 1 << 5
        kind = np.int64 if whole else object
        parts, entries, low, high = (x.astype(kind) for x in (parts, self.entries, self.low, self.high))
        lower, upper = np.zeros((n, k), kind), np.zeros((n, k), kind)
        for d in range(self.width):  # this coordinate's lookup tables: vector x cell
            x = parts[:, d : d + 1]
            under, over = low[d][None, :] - x, x - high[d][None, :]
            least = np.maximum(np.maximum(under, over), 0)
            most = np.maximum(abs(under), abs(over))
            least, most = least * least, most * most
            lower += least[:, self.cell[:, d]]
            upper += most[:, self.cell[:, d]]
        row, entry = np.nonzero(lower <= upper.min(axis=1)[:, None])
        apart = parts[row] - entries[entry]
        exact = (apart * apart).sum(axis=1)
        first = np.searchsorted(row, np.arange(n))  # the candidates of a row stand together, by entry
        best = np.minimum.reduceat(exact, first) if n else exact
        hit = np.flatnonzero(exact == best[row])
        take = hit[np.searchsorted(row[hit], np.arange(n))]
        return entry[take], exact[take]


def _filters(books: Codebooks) -> list[CellFilter]:
    return [CellFilter(part) for part in books.entries]


def _limbs(x: int) -> list[int]:
    """x in limbs of LIMB bits, least first; the last one has the sign."""
    out = []
    while not -(1 << LIMB) <= x < 1 << LIMB:
        out.append(x & ((1 << LIMB) - 1))
        x >>= LIMB
    return [*out, x]


def _summed(books: Codebooks):
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of this task's parts: (part, entry, position, limb, value); position -1 counts the parts."""
        filters = _filters(books)
        width = books.dims // len(filters) if filters else 0
        total: dict[tuple[int, int], list[int]] = {}
        for batch in batches:
            for i in range(len(batch)):
                data = _unpacked(batch, i, books.dims)
                for p, search in enumerate(filters):
                    part = data[:, p * width : (p + 1) * width]
                    entry, _ = search.nearest(part)
                    for e in np.unique(entry).tolist():
                        mine = part[entry == e]
                        sums = [len(mine), *(int(x) for x in mine.sum(axis=0))]
                        total[p, e] = [a + b for a, b in zip(total.get((p, e), [0] * (width + 1)), sums, strict=True)]
        rows = [(p, e, at - 1, limb, value) for (p, e), sums in total.items() for at, x in enumerate(sums) for limb, value in enumerate(_limbs(x))]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int32()] * 4 + [pa.int64()], strict=True)], ["part", "entry", "position", "limb", "value"])

    return summed


def _coded(books: Codebooks):
    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = _filters(books)
        width = books.dims // len(filters) if filters else 0
        hexed = np.array([f"{k:02x}" for k in range(256)])
        for batch in batches:
            for i in range(len(batch)):
                data = _unpacked(batch, i, books.dims)
                code, each = np.full(len(data), "", "U1"), []
                for p, search in enumerate(filters):
                    entry, far = search.nearest(data[:, p * width : (p + 1) * width])
                    code = np.char.add(code, hexed[entry])
                    each.append(far)
                if all(far.dtype != object and far.max(initial=0) < (1 << 62) // len(each) for far in each):
                    error = np.sum(each, axis=0, dtype=np.int64) if each else np.zeros(len(data), np.int64)
                else:
                    error = np.array([min(sum(map(int, x)), _LONG) for x in zip(*each, strict=True)], np.int64)
                shown = pa.array(error)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").slice(i, 1).flatten(), batch.column("label").slice(i, 1).flatten(), pa.array(code.tolist(), pa.string()), shown], ["vec_id", "label", "code", "error"])

    return coded


def learn(blocks: DataFrame, first: list[list[int]], dims: int, parts: int, rounds: int) -> Codebooks:
    """Codebooks after so many rounds, from the vectors that give the first entries. A round is one pass over the blocks."""
    width = dims // parts
    books = Codebooks([[v[p * width : (p + 1) * width] for v in first] for p in range(parts)], dims)
    for _ in range(rounds):
        sums = blocks.mapInArrow(tidied(_summed(books)), "part int, entry int, position int, limb int, value long").groupBy("part", "entry", "position", "limb").agg(F.sum("value").alias("value"))
        total: dict[tuple[int, int], dict[int, int]] = {}
        for r in sums.collect():  # parts x entries x (width + 1) numbers, a limb or few each
            mine = total.setdefault((r.part, r.entry), {})
            mine[r.position] = mine.get(r.position, 0) + (r.value << (LIMB * r.limb))
        books = Codebooks([[[total[p, e][d] // total[p, e][-1] for d in range(width)] if (p, e) in total else entry for e, entry in enumerate(part)] for p, part in enumerate(books.entries)], dims)
    return books


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, Codebooks]:
    """vectors (vec_id, embedding, label) -> (vec_id, label, code, error), and the codebooks. entries is 256 at most."""
    x = F.col("embedding")
    fine = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.cast("array<double>").alias("embedding")).where(fine.alias("fine"))
    longest = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    dims = -(-longest // parts) * parts
    heads = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()
    first = []
    for (v,) in heads:
        whole = [int(c) for c in scaled(np.array(v, np.float64), scale)]
        first.append(whole + [0] * (dims - len(whole)))
    blocks = durable(rows.mapInArrow(tidied(_packed(scale, dims)), _BLOCKS))
    books = learn(blocks, first, dims, parts, rounds) if first and dims else Codebooks([], 0)
    return blocks.mapInArrow(tidied(_coded(books)), "vec_id long, label long, code string, error long"), books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """coded with label_error: the errors of its label summed up (nulls are one label), and no label gathered: sums combine before
    their shuffle, and the labels come back by broadcast if they are few, else by a join in which Spark splits a frequent one."""
    coded = durable(coded)
    sums = durable(coded.groupBy(F.col("label").alias("_label")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONG).cast("decimal(38,0)")).cast("long").alias("label_error")))
    return coded.join(small_or_shuffled(sums), F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return with_label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _sql() -> str:
    """Seven assignments and six replacements as a chain of tables."""
    far = "list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    out = """
WITH k AS (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT rid, p, x[p * (len(x) // 8) + 1 : (p + 1) * (len(x) // 8)] AS x FROM k, unnest(range(8)) AS u(p)),
f AS (SELECT rid, row_number() OVER (ORDER BY vec_id, x) - 1 AS e FROM k ORDER BY vec_id, x LIMIT 16),
b0 AS MATERIALIZED (SELECT p, e, x FROM v JOIN f USING (rid))"""
    for r in range(7):
        out += f""",
a{r} AS MATERIALIZED (
  SELECT rid, v.p, min({{'far': {far}, 'e': b.e}}) AS best FROM v JOIN b{r} AS b ON v.p = b.p GROUP BY rid, v.p)"""
        if r < 6:
            out += f""",
s{r} AS (
  SELECT p, e, i, sum(x[i]) AS s, count(*) AS n FROM (SELECT p, best.e AS e, x FROM a{r} JOIN v USING (rid, p)) AS q, unnest(range(1, len(x) + 1)) AS u(i) GROUP BY p, e, i),
b{r + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(n.x, b.x) AS x FROM b{r} AS b LEFT JOIN (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM s{r} GROUP BY p, e) AS n USING (p, e))"""
    return out + """,
c AS (SELECT rid, string_agg(format('{:02x}', best.e), '' ORDER BY p) AS code, CAST(sum(best.far) AS BIGINT) AS error FROM a6 GROUP BY rid),
h AS (SELECT sha256(string_agg(CAST(x[i] AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM b6, unnest(range(1, len(x) + 1)) AS u(i))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c JOIN k USING (rid), h
"""


OP13_SQL = _sql()
