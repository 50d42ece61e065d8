"""Benchmark decontamination by a distributed positional inverted index.

build_index cuts the documents into segments of about SEGMENT bytes of texts and stores for each one a dictionary of terms, each term's
postings (the places of its words, ascending) and its documents. A segment is made and searched in the task that holds it, so neither a
frequent term nor a frequent passage gathers anywhere, and no row of the index is shuffled.

A search takes windows of a benchmark's words. In a segment, a window's terms are ordered by how many postings they have there; a window
with an absent term is out at once. The rarest term's postings, less the term's offset in the window, are the possible starts; they
are intersected with the next rarer term's offset-adjusted postings, and so on. What remains are exact phrases. For proximity matches each
term may stand up to `slack` places off its own place, before or behind.

Windows travel to the segments in groups of at most GROUP bytes, measured; a benchmark of several groups takes a pass of the index each,
and the documents' hits are put together by an aggregation.

Defined results: documents and items that are null or without words have no windows and no hits, but each row of documents has a row
of results; repeated doc_ids are rows each, a null doc_id is carried through; items without item_id take no part; rows that repeat an
item_id are one item; texts of any length are indexed whole (a longer text than SEGMENT is a segment of its own); empty tables give no
rows or no hits; further columns do not matter. Words are told apart by 64-bit hashes: a wrong match needs hashes of all words of
a window to collide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlux.llm import _grams as G
from parlux.llm._durable import durable, tidied

#: Bytes of texts in a segment, and free places between its documents: a window with its slack on both sides is to be shorter.
SEGMENT, GAP = 1 << 20, 64
#: Words of a window.
WINDOW = 10
#: Bytes of windows that travel to the segments at a time.
GROUP = 16 << 20
#: Possible starts that are looked at together.
STARTS = 1 << 19
#: What words are made of, once A-Z are lower-cased: digits, a-z, and all beyond ASCII.
_IN_WORD = G.lut(bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))
_INDEX = "doc_id array<long>, n_words binary, terms binary, counts binary, places binary"
_MATCHES = "segment long, ordinal int, doc_id long, item_id long, kind string, start int, length int"
_HITS = "segment long, ordinal int, doc_id long, n_words long, hits array<struct<lo:int,hi:int>>, items array<long>"


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of each word, in order."""
    solid = np.zeros(len(data) + 1, bool)
    solid[:-1] = _IN_WORD[data]
    first, last = solid[:-1].copy(), solid[:-1].copy()
    edge = offs[(offs > 0) & (offs < len(data))]
    first[1:] &= ~solid[:-2]
    first[edge] = solid[edge]
    last &= ~solid[1:]
    last[edge - 1] = solid[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1


def _pack(x: np.ndarray, kind: type) -> bytes:
    return zstandard.compress(x.astype(kind).tobytes(), 1)


def _unpack(x: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(x), kind)


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) -> segments. Places are stored as steps from the term's place before, the first one from 0."""
    for batch in batches:
        for lo, hi, data, offs in G.pieces(batch.column(1), SEGMENT):
            start, end, doc = words(data, offs)
            keys = G.Spans(data, lower=True).hash(start, end)
            order = np.argsort(keys, kind="stable")
            keys, places = keys[order], (np.arange(len(doc)) + GAP * doc)[order]
            first = np.ones(len(keys), bool)
            first[1:] = keys[1:] != keys[:-1]
            steps = np.diff(places, prepend=0)
            steps[first] = places[first]
            at = np.flatnonzero(first)
            packed = [_pack(np.bincount(doc, minlength=hi - lo), np.int32), _pack(keys[at], np.uint64), _pack(np.diff(np.append(at, len(keys))), np.int32), _pack(steps, np.int32)]
            ids = pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), batch.column(0).slice(lo, hi - lo))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([x], pa.binary()) for x in packed)], ["doc_id", "n_words", "terms", "counts", "places"])


def build_index(documents: DataFrame) -> DataFrame:
    """The segments of documents (doc_id, text), stored durably, with a number each."""
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return durable(rows.mapInArrow(tidied(_indexed), _INDEX).select(F.monotonically_increasing_id().alias("segment"), "*"))


def _windows(size: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (item_id, text) -> (item_id, window: the hashes of its words)."""
        for batch in batches:
            for lo, hi, data, offs in G.pieces(batch.column(1)):
                start, end, doc = words(data, offs)
                keys = G.Spans(data, lower=True).hash(start, end)
                many = np.bincount(doc, minlength=hi - lo)
                ids, windows, at = batch.column(0).slice(lo, hi - lo), [], []
                before = np.cumsum(many) - many
                for item in np.flatnonzero(many).tolist():
                    for k in range(max(1, int(many[item]) - size + 1)):
                        windows.append(keys[before[item] + k : before[item] + min(k + size, int(many[item]))].tobytes())
                        at.append(item)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array(windows, pa.binary())], ["item_id", "window"])

    return cut


class Windows:
    """A group of windows by length, over one vocabulary."""

    def __init__(self, pairs: list[tuple[int, bytes]]):
        distinct = sorted({w for _, w in pairs})
        number = {w: k for k, w in enumerate(distinct)}
        keys = [np.frombuffer(w, np.uint64) for w in distinct]
        self.vocabulary = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
        self.length = np.array([len(k) for k in keys], np.int64)
        #: length -> (windows' numbers, their terms' places in the vocabulary)
        self.by_length = {n: (at := np.flatnonzero(self.length == n), np.searchsorted(self.vocabulary, np.stack([keys[i] for i in at]))) for n in np.unique(self.length).tolist()}
        owners = sorted({(number[w], item) for item, w in pairs})
        self.item = np.array([item for _, item in owners], np.int64)
        self.items_from = np.searchsorted([w for w, _ in owners], np.arange(len(distinct) + 1))

    def items(self, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in window, item_id) of all items of some windows."""
        many = self.items_from[window + 1] - self.items_from[window]
        return np.repeat(np.arange(len(window)), many), self.item[_ranges(self.items_from[window], many)]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] of them), start[1], ..."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


class Segment:
    """One segment's documents and the postings of a vocabulary."""

    def __init__(self, row: dict, vocabulary: np.ndarray):
        self.docs, self.n_words = row["doc_id"], _unpack(row["n_words"], np.int32).astype(np.int64)
        self.first = np.cumsum(self.n_words + GAP) - self.n_words - GAP
        terms, counts = _unpack(row["terms"], np.uint64), _unpack(row["counts"], np.int32).astype(np.int64)
        at = np.searchsorted(terms, vocabulary)
        known = at < len(terms)
        known[known] = terms[at[known]] == vocabulary[known]
        #: postings of each term of the vocabulary, one list behind the other: how many, and where they begin
        self.count = np.zeros(len(vocabulary), np.int64)
        self.count[known] = counts[at[known]]
        self.begin = np.cumsum(self.count) - self.count
        self.span = int((self.n_words + GAP).sum()) + GAP
        self.places = np.zeros(0, np.int64)
        if known.any():
            steps = _unpack(row["places"], np.int32)[_ranges((np.cumsum(counts) - counts)[at[known]], self.count[known])].astype(np.int64)
            run, begin = np.cumsum(steps), self.begin[known]
            self.places = run - np.repeat(run[begin] - steps[begin], self.count[known])
        #: (term, place) as one number, ascending
        self.keys = np.repeat(np.arange(len(vocabulary)) * self.span, self.count) + self.places

    def matches(self, windows: Windows, slack: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(window, place) of all starts at which each term of the window stands at its own place, or up to slack off it."""
        found = [np.zeros((2, 0), np.int64)]
        for length, (numbers, terms) in windows.by_length.items():
            many = self.count[terms]
            live = np.flatnonzero(many.min(axis=1) > 0)
            order = np.argsort(many[live], axis=1, kind="stable")
            terms = np.take_along_axis(terms[live], order, 1)
            starts = np.cumsum(self.count[terms[:, 0]] * (2 * slack + 1))
            lo = 0
            while lo < len(live):
                hi = max(lo + 1, int(np.searchsorted(starts, (starts[lo - 1] if lo else 0) + STARTS, "right")))
                window, place = self._intersect(terms[lo:hi], order[lo:hi], length, slack)
                found.append(np.stack([numbers[live[lo + window]], place]))
                lo = hi
        window, place = np.concatenate(found, axis=1)
        return window, place

    def _intersect(self, terms: np.ndarray, offset: np.ndarray, length: int, slack: int) -> tuple[np.ndarray, np.ndarray]:
        """terms and their offsets in the window, rarest first."""
        rarest = terms[:, 0]
        window = np.repeat(np.arange(len(terms)), self.count[rarest])
        place = self.places[_ranges(self.begin[rarest], self.count[rarest])] - offset[window, 0]
        if slack:
            each = np.arange(-slack, slack + 1)
            window, place = np.repeat(window, len(each)), (place[:, None] + each).ravel()
            both = np.unique(np.stack([window, place], 1), axis=0)
            window, place = both[:, 0], both[:, 1]
        for k in range(0 if slack else 1, length):
            fits = (place >= -slack) & (place + length <= self.span)
            window, place = window[fits], place[fits]
            term, at = terms[window, k], place + offset[window, k]
            least, most = term * self.span + np.maximum(at - slack, 0), term * self.span + np.minimum(at + slack, self.span - 1)
            to = np.searchsorted(self.keys, least)
            hit = to < len(self.keys)
            hit[hit] = self.keys[to[hit]] <= most[hit]
            window, place = window[hit], place[hit]
        fits = place >= -slack
        return window[fits], place[fits]

    def document(self, place: np.ndarray) -> np.ndarray:
        """The document in which a match starts; a start may lie up to the slack before its document."""
        return np.searchsorted(self.first, place + GAP // 2, "right") - 1


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(len(batch)):
            yield {"doc_id": batch.column("doc_id").slice(i, 1).flatten()} | {name: batch.column(name)[i].as_py() for name in ("segment", "n_words", "terms", "counts", "places")}


def _listed(pairs: list[tuple[int, bytes]], slack: int | None):
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(pairs)
        for row in _rows(batches):
            segment = Segment(row, windows.vocabulary)
            exact = segment.matches(windows)
            kinds = {"phrase": exact}
            if slack:
                window, place = segment.matches(windows, slack)
                near = set(zip(*(x.tolist() for x in exact), strict=True))
                fresh = [not any((w, p + d) in near for d in range(-slack, slack + 1)) for w, p in zip(window.tolist(), place.tolist(), strict=True)]
                window, place = window[fresh], place[fresh]
                order = np.lexsort((place, window))
                window, place = window[order], place[order]
                opens = np.ones(len(window), bool)  # starts next to each other are one match
                opens[1:] = (window[1:] != window[:-1]) | (place[1:] != place[:-1] + 1)
                kinds["near"] = window[opens], place[opens]
            for kind, (window, place) in kinds.items():
                at, item = windows.items(window)
                doc = segment.document(place[at])
                columns = [pa.array(np.full(len(at), row["segment"])), pa.array(doc, pa.int32()), segment.docs.take(pa.array(doc)), pa.array(item), pa.array([kind] * len(at), pa.string()), pa.array(place[at] - segment.first[doc], pa.int32()), pa.array(windows.length[window[at]], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["segment", "ordinal", "doc_id", "item_id", "kind", "start", "length"])

    return listed


def _hit(pairs: list[tuple[int, bytes]]):
    def hit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each document: the runs of its words that are hit, and the items that occur."""
        windows = Windows(pairs)
        for row in _rows(batches):
            segment = Segment(row, windows.vocabulary)
            window, place = segment.matches(windows)
            n = len(segment.n_words)
            step = np.zeros(segment.span + GAP + 1, np.int64)
            np.add.at(step, place, 1)
            np.add.at(step, place + windows.length[window], -1)
            edges = np.diff(np.concatenate([[0], np.cumsum(step) > 0, [0]]).astype(np.int8))
            lo, hi = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
            doc = segment.document(lo)
            runs = pa.StructArray.from_arrays([pa.array(x - segment.first[doc], pa.int32()) for x in (lo, hi)], ["lo", "hi"])
            runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32()), runs)
            seen = np.unique(np.stack([segment.document(place), window], 1), axis=0)
            at, item = windows.items(seen[:, 1])
            pairs_of = np.unique(np.stack([seen[at, 0], item], 1), axis=0)
            items = pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs_of[:, 0], np.arange(n + 1)), pa.int32()), pa.array(pairs_of[:, 1]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, row["segment"])), pa.array(np.arange(n), pa.int32()), segment.docs, pa.array(segment.n_words), runs, items], ["segment", "ordinal", "doc_id", "n_words", "hits", "items"])

    return hit


def _groups(benchmark: DataFrame, size: int) -> Iterator[list[tuple[int, bytes]]]:
    """The benchmark's distinct (item_id, window), in groups of about GROUP bytes at most; one group, if there are none."""
    rows = benchmark.where("item_id is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    pairs = durable(rows.mapInArrow(tidied(_windows(size)), "item_id long, window binary").distinct())
    groups = -(-(pairs.agg(F.sum(F.octet_length("window") + 8)).first()[0] or 1) // GROUP)
    for k in range(groups):
        yield [tuple(r) for r in pairs.where(F.pmod(F.xxhash64("item_id", "window"), F.lit(groups)) == k).collect()]


def find_matches(index: DataFrame, benchmark: DataFrame, slack: int | None = None, window: int = WINDOW) -> DataFrame:
    """Where windows of a benchmark (item_id, text) occur in an index: segment, ordinal (the document's place in it), doc_id, item_id,
    kind, start (the first word's place in the document), length.

    kind is phrase for exact occurrences. With slack there are also rows of kind near: a start from which each word of the window
    stands within slack places of its own, and no phrase of that window starts within slack places; of starts next to each other
    the first is given, which may lie up to slack places before the text."""
    if window + 2 * (slack or 0) >= GAP:
        raise ValueError(f"a window and its slack on both sides have to be shorter than {GAP} words")
    found = [index.mapInArrow(tidied(_listed(pairs, slack)), _MATCHES) for pairs in _groups(benchmark, window)]
    return _all(found)


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def _covered(runs: Column) -> Column:
    """How many places some runs cover together."""
    begin = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    step = lambda a, r: F.struct((a["n"] + F.greatest(F.lit(0), r["hi"] - F.greatest(a["to"], r["lo"]))).alias("n"), F.greatest(a["to"], r["hi"]).alias("to"))
    return F.aggregate(F.array_sort(runs), begin, step)["n"]


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each row of documents (doc_id, text): doc_id, n_words, n_hit (words inside a window's occurrence), items (the
    item_ids that occur, sorted as strings)."""
    if window >= GAP:
        raise ValueError(f"a window has to be shorter than {GAP} words")
    index = build_index(documents)
    found = [index.mapInArrow(tidied(_hit(pairs)), _HITS) for pairs in _groups(benchmark, window)]
    rows = found[0]
    if len(found) > 1:
        rows = _all(found).groupBy("segment", "ordinal").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return rows.select("doc_id", "n_words", _covered(F.col("hits")).alias("n_hit"), F.array_sort(F.transform("items", lambda x: x.cast("string"))).alias("items"))


def op12_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
t AS (
  SELECT DISTINCT item_id, array_to_string(w[i : i + 9], ' ') AS phrase, least(len(w), 10) AS n FROM b, unnest(range(1, greatest(len(w) - 8, 2))) AS u(i) WHERE len(w) > 0),
g AS (
  SELECT rid, i, n, array_to_string(w[i : i + n - 1], ' ') AS phrase FROM d, (SELECT DISTINCT n FROM t) AS l, unnest(range(1, len(w) - n + 2)) AS u(i)),
m AS (SELECT rid, i, n, item_id FROM g JOIN t USING (phrase, n)),
h AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT rid, i, n FROM m) AS q, unnest(range(i, i + n)) AS u(k) GROUP BY rid),
s AS (SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS x FROM m) AS q GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN s USING (rid)
"""
