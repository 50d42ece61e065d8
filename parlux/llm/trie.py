"""A prefix trie of conversations: one node for each distinct sequence of first turns.

Turns lie in one global order (range partitions, which also split a long conversation), and a numpy scan rolls a polynomial fingerprint
along each conversation; each partition reports how its last conversation ends (one row a partition), which starts the next one's scan.
Turns of equal depth and fingerprint are the candidates for a node. They collapse by an aggregation over depth, fingerprint, the parent's
fingerprint, role and text, so every member's turn is compared in full, and a node that all conversations share is combined before
the shuffle. A candidate with one such variant is a node: all its members have its representative's last turn behind one parent,
and so on up to the root. Where there are more variants, fingerprints collided: the variants other than the representative's get
a number, numbers are rolled along the conversations like fingerprints and tell the nodes below apart as well, and all is verified
again, until each candidate has one variant. So the result never depends on fingerprints.

Sums over subtrees take no rounds by level. A node belongs to its representative, its smallest member; the nodes of one representative
are the end of its conversation. So a subtree's sum is the sum, over the conversations through its top, of what they own from that
depth on: a conversation's total less a running sum, added up by node.

Defined results: turns are ordered by turn (null first), ties by role, then text; null and empty role or text are the same; rows that
repeat all columns are turns each; rows without conv_id take no part; a conversation without turns (left so by a skip) is a member of the
root alone; an empty table gives no rows, not even a root; texts are compared whole; further columns do not matter."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlux.llm._durable import WORD, durable, running_sums, tidied
from parlux.llm.chat import roll

#: Bits of a fingerprint that are looked at.
BITS = 64
#: 2**PIECE neighbouring conv_ids at most are put together at a time, for the hash of a list of ids.
PIECE = 16
#: Characters of role and text by which rows are dealt to partitions; inside one they are sorted by the whole.
SAMPLED = 64
#: Most turns that a conversation can be told to skip.
SKIP = 3
_BASE = np.uint64(0x9E3779B97F4A7C15)
_ALL = (1 << 64) - 1
_KEY = ["depth", "h", "s"]
_END = pa.schema([("_part", pa.int32()), ("conv", pa.int64()), ("skip", pa.int32()), ("whole", pa.bool_()), ("own", pa.int64()), ("n", pa.list_(pa.int64())), ("h", pa.list_(pa.int64())), ("s", pa.list_(pa.int64()))])
_END_SQL = "_part int, conv long, skip int, whole boolean, own long, n array<long>, h array<long>, s array<long>"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _columns(batch: pa.RecordBatch):
    """conv, skip, own, fingerprints' keys, split numbers; and where conversations begin."""
    conv, skip = batch.column("conv").to_numpy(), batch.column("skip").to_numpy()
    own = batch.column("own").to_numpy(zero_copy_only=False)
    k, v = (batch.column(c).to_numpy().view(np.uint64) for c in ("k", "v"))
    first = np.ones(len(conv), bool)
    first[1:] = conv[1:] != conv[:-1]
    return conv, skip, own, k, v, first


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How a partition's last conversation ends, for each number of own turns that may still have to be skipped when it begins: turns,
    fingerprint and split; own is how many own turns it has here, whole says that it is the partition's first as well."""
    part, last, whole, owned, states = None, (None, 0), True, 0, []
    for batch in batches:
        if not len(batch):
            continue
        conv, skip, own, k, v, first = _columns(batch)
        part = batch.column("_part")[0].as_py()
        at = int(np.flatnonzero(first)[-1])
        same = bool(states) and last[0] == int(conv[0])
        whole = whole and not at and (same or not states)
        if at or not same:
            owned, states = 0, [[left, 0, 0, 0] for left in range(SKIP + 1)]
        last = int(conv[-1]), int(skip[-1])
        mine, k, v = own[at:], k[at:], v[at:]
        for state in states:
            left, n, h, s = state
            keep = ~mine | (np.cumsum(mine) > left)
            only = np.zeros(int(keep.sum()), bool)
            if len(only):
                only[0] = True
                h, s = (int(roll(x[keep], only, _BASE, y)[-1]) for x, y in ((k, h), (v, s)))
            state[:] = max(0, left - int(mine.sum())), n + len(only), h, s
        owned += int(mine.sum())
    if part is not None:
        row = {"_part": part, "conv": last[0], "skip": last[1], "whole": whole, "own": owned, "n": [x[1] for x in states], "h": [_signed(x[2]) for x in states], "s": [_signed(x[3]) for x in states]}
        yield pa.RecordBatch.from_pylist([row], _END)


def _scanned(carry: dict[int, tuple[int | None, int, int, int, int]], mask: int):
    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The turns that are not skipped, with depth, fingerprint and split, and those of the turn before."""
        state = None
        for batch in batches:
            if not len(batch):
                continue
            if state is None:
                state = carry.get(batch.column("_part")[0].as_py(), (None, 0, 0, 0, 0))
            conv, skip, own, k, v, first = _columns(batch)
            goes_on = state[0] == int(conv[0])
            _, depth, owned, h, s = state if goes_on else (None, 0, 0, 0, 0)
            run = np.cumsum(first) - 1
            before = np.cumsum(own) - own
            index = before - before[first][run] + np.where(run == 0, owned, 0)
            keep = np.flatnonzero(~own | (index >= skip))
            run_kept = run[keep]
            opens = np.ones(len(keep), bool)
            opens[1:] = run_kept[1:] != run_kept[:-1]
            mine = bool(len(keep)) and run_kept[0] == 0  # the conversation that goes on has turns here
            columns = {}
            for name, x, y in (("h", k, h), ("s", v, s)):
                got = roll(x[keep], opens, _BASE, y if mine else 0)
                prior = np.where(opens, np.uint64(0), np.concatenate([[np.uint64(0)], got[:-1]])) if len(got) else got
                if mine:
                    prior[0] = np.uint64(y)
                columns |= {name: got, name + "p": prior}
            at = np.arange(len(keep))
            deep = at - np.maximum.accumulate(np.where(opens, at, 0)) + 1 + np.where(run_kept == 0, depth, 0)
            tail = run[-1]
            some = bool(len(keep)) and run_kept[-1] == tail
            was = (depth, h, s) if tail == 0 else (0, 0, 0)
            ended = (int(deep[-1]), int(columns["h"][-1]), int(columns["s"][-1])) if some else was
            state = (int(conv[-1]), ended[0], int(own[run == tail].sum()) + (owned if tail == 0 else 0), ended[1], ended[2])
            cut = batch.take(pa.array(keep))
            masked = {n: pa.array((x & np.uint64(mask) if n[0] == "h" else x).view(np.int64)) for n, x in columns.items()}
            yield pa.RecordBatch.from_arrays([*(cut.column(c) for c in ("conv", "k", "v", "role", "text")), pa.array(deep, pa.int64()), *masked.values()], ["conv", "k", "v", "role", "text", "depth", *masked])

    return scanned


def _scan(placed: DataFrame) -> DataFrame:
    """Rows in order, with their partition's number, scanned."""
    carry, state = {}, (None, 0, 0, 0, 0)
    for r in placed.select("_part", "conv", "skip", "own", "k", "v").mapInArrow(tidied(_ends), _END_SQL).orderBy("_part").collect():  # one row a partition
        carry[r["_part"]] = state
        conv, depth, owned, h, s = state if r["whole"] and state[0] == r["conv"] else (r["conv"], 0, 0, 0, 0)
        left = max(0, r["skip"] - owned)
        step = pow(int(_BASE), r["n"][left], 1 << 64)
        state = (conv, depth + r["n"][left], owned + r["own"], (h * step + r["h"][left]) & _ALL, (s * step + r["s"][left]) & _ALL)
    schema = "conv long, k long, v long, role string, text string, depth long, h long, hp long, s long, sp long"
    return placed.mapInArrow(tidied(_scanned(carry, (1 << BITS) - 1)), schema)


def _placed(rows: DataFrame, order: list, within: list) -> DataFrame:
    return durable(rows.repartitionByRange(*order).sortWithinPartitions(*order, *within).withColumn("_part", F.spark_partition_id()))


def _turns(conversations: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))


def verified_paths(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """turns (conv, own, skip, turn, role, text; own turns behind all others) -> (the turns with depth, h, s: the key of their node;
    the nodes below the root: key, hp, sp (parent's h and s), conv, n_convs, text)."""
    order = ["conv", "own", F.col("turn").asc_nulls_first(), F.left("role", F.lit(SAMPLED)), F.left("text", F.lit(SAMPLED))]
    rows = durable(_scan(_placed(turns.withColumns({"k": F.xxhash64("role", "text"), "v": F.lit(0).cast("long")}), order, ["role", "text"])))
    kind = [*_KEY, "hp", "sp", "role", "text"]
    while True:
        variants = durable(rows.groupBy(*kind).agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs")))
        split = durable(variants.groupBy(*_KEY).agg(F.count("*").alias("n")).where("n > 1").drop("n"))
        if not split.take(1):
            return rows.select("conv", *_KEY), variants.drop("role")
        # collided fingerprints: variants but the representative's get numbers, and what stands below them is told apart by the scan
        number = F.row_number().over(Window.partitionBy(*_KEY).orderBy("conv", "hp", "sp", "role", "text"))
        others = durable(variants.join(split, _KEY).withColumn("number", number).where("number > 1").select(*kind, "number"))
        again = rows.join(others, kind, "left").withColumn("v", F.when(F.col("number").isNull(), F.col("v")).otherwise(F.xxhash64("v", "number")))
        again = again.select("conv", F.lit(True).alias("own"), F.lit(0).alias("skip"), "depth", "k", "v", "role", "text")
        rows = durable(_scan(_placed(again, ["conv", "depth"], [])))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of ids in pieces, sorted by node and piece -> the SHA-256 of each node's list; a list is hashed as it streams by."""
    at, digest = None, None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            key = tuple(row[c] for c in _KEY)
            if key != at:
                if at is not None:
                    out.append((*at, digest.hexdigest()))
                at, digest = key, hashlib.sha256(row["ids"].encode())
            else:
                digest.update(b"," + row["ids"].encode())
        yield _digest_rows(out)
    if at is not None:
        yield _digest_rows([(*at, digest.hexdigest())])


def _digest_rows(rows: list[tuple[int, int, int, str]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()], strict=True)], [*_KEY, "ends_sha256"])


def _trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """turns as for verified_paths, convs (conv; all conversations, also those without turns) -> the nodes."""
    paths, variants = verified_paths(turns)
    zero = F.lit(0).cast("long")
    paths = paths.union(convs.select("conv", zero, zero, zero))
    below = variants.select(*_KEY, "hp", "sp", "conv", "n_convs", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"))
    none = F.lit(None).cast("long")
    root = convs.agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs")).where("n_convs > 0").select(zero.alias("depth"), zero.alias("h"), zero.alias("s"), none.alias("hp"), none.alias("sp"), "conv", "n_convs", zero.alias("n_words"))
    nodes = durable(root.union(below))
    up = [(F.col("depth") - 1).alias("depth"), F.col("hp").alias("h"), F.col("sp").alias("s")]
    kids = nodes.where("depth > 0").groupBy(*up).agg(F.count("*").alias("n_children"))
    nodes = durable(nodes.join(kids, _KEY, "left").withColumn("n_children", F.coalesce("n_children", zero)))
    # what each conversation owns, along its path
    owned = nodes.select("conv", "depth", ((F.col("n_convs") - 1) * F.col("n_words")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    along = paths.join(owned, ["conv", "depth"], "left").withColumns({c: F.coalesce(c, zero) for c in ("saved", "leaf")})
    summed = running_sums(along, [F.col("conv"), F.col("depth")], {"saved_before": F.col("saved"), "leaf_before": F.col("leaf")})
    summed = durable(summed)
    last = summed.groupBy("conv").agg(F.max("depth").alias("end"), *(F.max(F.col(f"{c}_before") + F.col(c)).alias(f"{c}_end") for c in ("saved", "leaf")))
    joined = durable(summed.join(last, "conv"))
    sums = joined.groupBy(*_KEY).agg(*(F.sum(F.col(f"{c}_end") - F.col(f"{c}_before")).alias(n) for c, n in (("leaf", "n_leaves"), ("saved", "saved_tokens"))))
    ends = joined.where(F.col("depth") == F.col("end")).groupBy(*_KEY, F.shiftright("conv", PIECE).alias("piece")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    digests = ends.repartition(*_KEY).sortWithinPartitions(*_KEY, "piece").mapInArrow(tidied(_digests), "depth long, h long, s long, ends_sha256 string")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("h").alias("hp"), F.col("s").alias("sp"), F.col("conv").alias("parent_conv_id"))
    out = nodes.join(sums, _KEY).join(digests, _KEY, "left").join(parents, ["depth", "hp", "sp"], "left")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text), a row a node: conv_id (the smallest member; with depth it names the node),
    depth, parent_conv_id (null for the root), n_convs (members), n_children, n_leaves (childless nodes at or below it), saved_tokens
    (words of turns at or below it that a cache of prefixes would not read again), ends_sha256 (of its members that end here)."""
    turns = _turns(conversations)
    return _trie(turns.select("conv", F.lit(True).alias("own"), F.lit(0).alias("skip"), "turn", "role", "text"), durable(turns.select("conv").distinct()))


def with_shared_heads(conversations: DataFrame, family: int = 20) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations, as _trie takes them: conversation c begins with the first h turns of c - c % family (all, if it has fewer),
    then come its own turns but the first h; h is the CRC-32 of c in decimal, modulo SKIP + 1."""
    turns = _turns(conversations)
    skip = lambda c: (F.crc32(c.cast("string").cast("binary")) % (SKIP + 1)).cast("int")
    own = turns.select("conv", F.lit(True).alias("own"), skip(F.col("conv")).alias("skip"), "turn", "role", "text")
    convs = durable(turns.select("conv").distinct())
    first = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    heads = turns.where(F.col("conv") % family == 0).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= SKIP)
    heads = heads.select(F.col("conv").alias("base"), F.col("rank").cast("long").alias("turn"), "role", "text")
    lent = convs.select("conv", (F.col("conv") - F.col("conv") % family).alias("base"), skip(F.col("conv")).alias("skip"))
    lent = lent.join(heads, "base").where("turn <= skip").select("conv", F.lit(False).alias("own"), "skip", "turn", "role", "text")
    return lent.union(own), convs


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trie(*with_shared_heads(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


_BIT = "list_reduce(list_concat([{}], range(8)), lambda a, i: xor(a >> 1, 3988292384 * (a & 1)))"
_CRC = f"xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))), lambda r, b: {_BIT.format('xor(r, b)')}))"
OP11_SQL = f"""
WITH o AS (
  SELECT conv_id AS c, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS q
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
k AS (SELECT c, q, {_CRC} % 4 AS h FROM o),
r AS (SELECT k.c, list_concat(coalesce(b.q[1 : k.h], []), k.q[k.h + 1 :]) AS q FROM k LEFT JOIN o AS b ON b.c = k.c - k.c % 20),
m AS (SELECT c, d, q[1 : d] AS p, len(q) = d AS ends FROM r, unnest(range(len(q) + 1)) AS u(d)),
n AS MATERIALIZED (
  SELECT d, p, min(c) AS c, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256,
    CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(p[d].text, '[^\\x20\\x09-\\x0D]+')) END AS n_words
  FROM m GROUP BY d, p),
g AS (SELECT d - 1 AS d, p[1 : d - 1] AS p, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
x AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN g USING (d, p)),
s AS (
  SELECT d, p[1 : d] AS p, sum((n_convs - 1) * n_words) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT u.d, x.p, x.n_convs, x.n_words, x.n_children FROM x, unnest(range(x.d + 1)) AS u(d)) AS q GROUP BY ALL)
SELECT x.c AS conv_id, x.d AS depth, y.c AS parent_conv_id, x.n_convs, x.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, x.ends_sha256
FROM x JOIN s USING (d, p) LEFT JOIN n AS y ON y.d = x.d - 1 AND y.p = x.p[1 : x.d - 1]
"""

