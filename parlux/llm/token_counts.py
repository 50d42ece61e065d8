"""Token counts by heap-and-linked-list byte-pair merging.

The symbols of a part of a text form a linked list; all adjacent pairs that are pieces of the vocabulary wait in a heap by rank; the
lowest rank (ties: leftmost) is popped and merged until none is left. A text's count is its initial symbols minus its merges; no
identifiers are made. Characters outside the vocabulary count as their UTF-8 bytes (byte fallback).

Parts: a run of blanks with the word after it; no piece holds a blank behind another character, so merges never cross that place, nor
white space that no piece holds. Each distinct part is counted once a worker (a bounded table).

Defined results: a null or empty text has 0 bytes and 0 tokens; a null doc_id is carried through; repeated rows are counted each;
a text of any length is counted whole, in memory in proportion to itself; there is no shuffle, and further columns do not matter."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlux.llm import _grams as G
from parlux.llm._durable import tidied
from parlux.llm._tokens import PIECE, Table, _odd_docs

BLANK = "▁"
LIMIT = 4096


class PieceCounter:
    """Token counts of whole texts as the sentencepiece library gives them for a BPE model with byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or spec.precompiled_charsmap or spec.remove_extra_whitespaces:
            raise ValueError("only BPE models with byte fallback and without normalisation are counted here")
        normal = [(p.piece, p.score) for p in model.pieces if p.type == 1]
        if any(BLANK in p.lstrip(BLANK) for p, _ in normal):
            raise ValueError("a piece goes on beyond a blank")
        order = sorted({-s for _, s in normal})
        rank = {s: k for k, s in enumerate(order)}
        self.rank = {p: rank[-s] for p, s in normal}
        self.prefix = spec.add_dummy_prefix
        held = {c for p in self.rank for c in p}
        self.breaks = G.lut(bytes(b for b in range(0x09, 0x0E) if chr(b) not in held))
        self.table = Table(lambda parts: [[self.count(p)] for p in parts], np.uint32)

    def count(self, part: bytes) -> int:
        symbols = list(part.decode().replace(" ", BLANK))
        rank = self.rank
        weight = [1 if s in rank else len(s.encode()) for s in symbols]
        total, n = sum(weight), len(symbols)
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := rank.get(symbols[i] + symbols[i + 1])) is not None]
        if not heap:
            return total
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            _, i, left, right = heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue  # one of the two has been merged since
            total -= weight[i] + weight[j] - 1
            symbols[i] = merged = left + right
            symbols[j], weight[i] = "", 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                r = rank.get(merged + symbols[k])
                if r is not None:
                    heappush(heap, (r, i, merged, symbols[k]))
            k = before[i]
            if k >= 0:
                r = rank.get(symbols[k] + merged)
                if r is not None:
                    heappush(heap, (r, k, symbols[k], merged))
        return total

    def texts(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, UTF-8 bytes, tokens) of runs of rows."""
        for lo, hi, data, offs in G.pieces(column, PIECE):
            n = len(data)
            first = np.zeros(n, bool)
            blank, breaks = data == 32, self.breaks[data]
            first[1:] = (blank[1:] & ~blank[:-1]) | breaks[1:] | breaks[:-1]
            begins = offs[:-1][offs[:-1] < offs[1:]]
            first[begins] = True
            start = np.flatnonzero(first)
            doc = np.searchsorted(offs, start, "right") - 1
            odd = _odd_docs(data, offs, [BLANK.encode()])
            if odd.any():
                keep = ~odd[doc] | (start == offs[doc])
                start, doc = start[keep], doc[keep]
            end = np.append(start[1:], n)
            opens = (start == offs[doc]) & self.prefix
            hashes = G.Spans(data).hash(start, end)
            hashes = np.where(opens, G.mix(hashes ^ np.uint64(0x3C6EF372FE94F82B)), hashes)
            at, _ = self.table.find(hashes, lambda i, data=data, start=start, end=end, opens=opens: b" " * int(opens[i]) + data[start[i] : end[i]].tobytes())
            yield lo, hi, np.diff(offs), np.bincount(doc, self.table.pool[at], hi - lo).astype(np.int64)


_loaded: dict[str, PieceCounter] = {}


def piece_counter(path: str) -> PieceCounter:
    """The counter of a model file, loaded once a process."""
    if path not in _loaded:
        _loaded[path] = PieceCounter(path)
    return _loaded[path]


def forget() -> None:
    """Lets go of the counters and their tables."""
    _loaded.clear()


def count_tokens(docs: DataFrame, model_path: str, limit: int = LIMIT) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_bytes, n_tokens, over_limit."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, size, tokens in piece_counter(model_path).texts(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(size), pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidied(counted, forget), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
