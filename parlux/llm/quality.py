"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths are taken over a whole text with numpy, and the characters that lie in repeated n-grams
and in repeated lines are measured. A text passes if no coverage is above its threshold.

Defined results: a null or empty text has no words, zero for every count, and fails the base rule; a null doc_id is carried through;
repeated rows are judged each by itself and alike; further columns do not matter. A text of any length is judged whole.
Work is row by row: no shuffle, and memory is bounded by a piece of about 256 KiB of texts, or by one longer text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlux.llm import _grams as G
from parlux.llm._durable import renamed, tidied

#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
#: n-gram length -> the largest share of a text's word characters that may lie in repeats (the second time and later) of n-grams.
#: Repeats of a longer n-gram lie within those of a shorter one, so each longer one has a lower threshold, or it could not decide anything.
MAX_REPEATED = {5: 0.15, 7: 0.13, 10: 0.10}
#: The largest share of word characters that may lie in lines equal to an earlier one.
MAX_LINE_CHARS = 0.30
#: The base rule: fewest words, and most percent of words in 5-word windows found twice or more.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5

_MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "dup_line_chars", "n_repeat_words", *(f"dup_chars_{n}" for n in MAX_REPEATED)]
_SCHEMA = "doc_id long, " + ", ".join(f"{m} long" for m in _MEASURES) + ", base_failed boolean, kept boolean"


def measure(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The measures of each document of a piece of texts."""
    n_docs = len(offs) - 1
    start, end, doc = G.words(data, offs)
    spans = G.Spans(data)
    points = (data & 0xC0) != 0x80
    solid = ~G.IS_SPACE[data]
    chars_to = np.zeros(len(data) + 1, np.int64)
    np.cumsum(points & solid, out=chars_to[1:])
    count = lambda at, w=None: np.bincount(at, w, n_docs).astype(np.int64)
    out = {"n_words": count(doc), "word_chars": chars_to[offs[1:]] - chars_to[offs[:-1]], "n_symbols": G.per_doc(G.lut(SYMBOLS)[data], offs)}
    length = chars_to[end] - chars_to[start]
    line_start, line_end, owner = G.lines(data, offs)
    chars = chars_to[line_end] - chars_to[line_start]
    full = np.flatnonzero(chars)
    line_start, line_end, owner, chars = line_start[full], line_end[full], owner[full], chars[full]
    _, later = G.repeated(G.seeded(spans.hash(line_start, line_end), owner))
    out |= {"n_dup_lines": count(owner[later]), "dup_line_chars": count(owner[later], chars[later])}
    hashes = G.seeded(spans.hash(start, end), doc)
    for n in sorted({WINDOW, *MAX_REPEATED}):
        at, keys = G.grams(hashes, doc, n)
        some, later = G.repeated(keys)
        if n == WINDOW:
            out["n_repeat_words"] = count(doc[G.covered(at[some], n, len(doc))])
        if n in MAX_REPEATED:
            inside = G.covered(at[later], n, len(doc))
            out[f"dup_chars_{n}"] = count(doc[inside], length[inside])
    return out


def judge(found: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept) from the measures."""
    failed = (found["n_words"] < MIN_WORDS) | (100 * found["n_repeat_words"] > MAX_REPEAT_PERCENT * found["n_words"])
    good = ~failed & (found["dup_line_chars"] <= MAX_LINE_CHARS * found["word_chars"])
    for n, most in MAX_REPEATED.items():
        good &= found[f"dup_chars_{n}"] <= most * found["word_chars"]
    return failed, good


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offs in G.pieces(batch.column(1)):
            found = measure(data, offs)
            columns = [batch.column(0).slice(lo, hi - lo), *(pa.array(found[m]) for m in _MEASURES), *map(pa.array, judge(found))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *_MEASURES, "base_failed", "kept"])


def quality(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): its measures, base_failed and kept."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidied(_measured), _SCHEMA)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns as they were, whose text passes the rules: judged in the row, without a join or shuffle."""
    rows, name, back = renamed(docs)
    at = rows.columns.index(name["text"])

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in G.pieces(batch.column(at)):
                yield batch.slice(lo, hi - lo).filter(pa.array(judge(measure(data, offs))[1]))

    return back(rows.mapInArrow(tidied(passed), rows.schema))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    rest = [m for m in _MEASURES if m not in columns]
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(*columns, *rest)


_W = r"'[^\x20\x09-\x0D]+'"
OP5_SQL = f"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_W}) AS w FROM documents),
g AS (SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram FROM w, (VALUES {", ".join(f"({n})" for n in sorted({WINDOW, *MAX_REPEATED}))}) AS l(n), unnest(range(1, len(w) - n + 2)) AS u(i)),
r AS (SELECT rid, n, i, row_number() OVER (PARTITION BY rid, n, gram ORDER BY i) AS k, count(*) OVER (PARTITION BY rid, n, gram) AS c FROM g),
again AS (SELECT rid, n, CAST(sum(length(w[j])) AS BIGINT) AS chars FROM (SELECT DISTINCT rid, n, j FROM r, unnest(range(i, i + n)) AS u(j) WHERE k > 1) AS q JOIN w USING (rid) GROUP BY rid, n),
inside AS (SELECT rid, count(*) AS words FROM (SELECT DISTINCT rid, j FROM r, unnest(range(i, i + n)) AS u(j) WHERE n = {WINDOW} AND c > 1) AS q GROUP BY rid),
l AS (SELECT rid, list_sum(list_transform(regexp_extract_all(line, {_W}), lambda x: length(x))) AS chars, row_number() OVER (PARTITION BY rid, line) AS k FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM w) AS q WHERE regexp_matches(line, {_W})),
lines AS (SELECT rid, count(*) AS n, CAST(sum(chars) AS BIGINT) AS chars FROM l WHERE k > 1 GROUP BY rid),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    coalesce(lines.n, 0) AS n_dup_lines, coalesce(lines.chars, 0) AS dup_line_chars, coalesce(inside.words, 0) AS n_repeat_words, {", ".join(f"coalesce((SELECT chars FROM again WHERE again.rid = w.rid AND again.n = {n}), 0) AS dup_chars_{n}" for n in MAX_REPEATED)}
  FROM w LEFT JOIN lines USING (rid) LEFT JOIN inside USING (rid)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND dup_line_chars <= {MAX_LINE_CHARS}::DOUBLE * word_chars AND {" AND ".join(f"dup_chars_{n} <= {most}::DOUBLE * word_chars" for n, most in MAX_REPEATED.items())} AS kept FROM b
"""
