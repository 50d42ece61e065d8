"""Chat formatting with cumulative-snapshot collapse.

A log often holds a conversation several times, each time a few turns longer. Rolling hashes over the turns give every prefix of every
conversation a key; conversations whose whole key is a proper prefix of a longer one are removed by an anti-join, equal ones are
collapsed to the smallest conv_id, and only the maximal ones are rendered.

The hashes roll along a global order (range partitions, split inside a conversation where it is long): each partition reports how its
last conversation ends (one row a partition), which gives the next partitions their start, so no conversation is gathered in a task.
A rendering comes in parts of PART turns (nearly all have one part), so that one endless conversation is not one row either.

Defined results: turns are ordered by turn (null first), then role (its first 64 characters), then a hash of role and text; rows that repeat all four columns are one turn;
null and empty role or text are the same; turns without conv_id are one conversation with a null id, the last among equal ones;
further columns do not matter; an empty table gives no rows; texts of any length are rendered whole."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlux.llm._durable import durable, small_or_shuffled, tidied

#: Turns in a part of a rendering.
PART = 512
#: What stands before the role, between role and text, and behind the text.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_ROLLED = "conv long, turn long, k0 long, k1 long, pos long, h0 long, h1 long"
#: Characters of the role that order turns of one number; with them no long text goes into the samples for the order.
ROLE = 64


def roll(keys: np.ndarray, first: np.ndarray, base: np.uint64, carry: int) -> np.ndarray:
    """h[i] = base * h[i-1] + keys[i] modulo 2**64, starting anew with each True of first; carry is h before the first key."""
    out = np.empty(len(keys), np.uint64)
    starts = np.flatnonzero(first)
    length = np.diff(np.append(starts, len(keys)))
    before = np.zeros(len(starts), np.uint64)
    if len(starts):
        before[0] = np.uint64(carry)
    order = np.argsort(-length, kind="stable")
    starts, length, before = starts[order], length[order], before[order]
    step = 0
    while len(starts):  # the step-th turn of all runs that have one
        if len(starts) == 1:
            h, mask = int(before[0]), (1 << 64) - 1
            for i in range(int(starts[0]) + step, int(starts[0] + length[0])):
                h = (h * int(base) + int(keys[i])) & mask
                out[i] = h
            break
        before = before * base + keys[starts + step]
        out[starts + step] = before
        step += 1
        more = int(np.searchsorted(-length, -step))
        starts, length, before = starts[:more], length[:more], before[:more]
    return out


def _arrays(batches: list[pa.RecordBatch]):
    table = pa.Table.from_batches(batches).combine_chunks()
    conv = table.column("conv")
    ids, null = conv.fill_null(0).to_numpy(), conv.is_null().to_numpy(zero_copy_only=False)
    first = np.ones(len(ids), bool)
    first[1:] = (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])
    return table, ids, null, first


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How the last conversation of the partition ends: its id, turns and keys so far, whether it is the partition's first as well."""
    part, conv, whole, count, state = None, None, True, 0, [0, 0]
    for batch in batches:
        if not len(batch):
            continue
        table, ids, null, first = _arrays([batch])
        part = table.column("_part")[0].as_py()
        same = count and conv == (None if null[0] else int(ids[0]))
        last = int(np.flatnonzero(first)[-1])
        whole = (whole and not last) and (same or not count)
        if last or not same:
            count, state = 0, [0, 0]
        tail = slice(last, len(ids))
        only = np.zeros(len(ids) - last, bool)
        only[0] = True
        state = [int(roll(table.column(f"k{k}").to_numpy().view(np.uint64)[tail], only, base, state[k])[-1]) for k, base in enumerate(_BASES)]
        count += len(only)
        conv = None if null[-1] else int(ids[-1])
    if part is not None:
        signed = np.array(state, np.uint64).view(np.int64).tolist()
        yield pa.RecordBatch.from_pylist([{"_part": part, "conv": conv, "whole": bool(whole), "n": count, "h0": signed[0], "h1": signed[1]}], pa.schema([("_part", pa.int32()), ("conv", pa.int64()), ("whole", pa.bool_()), ("n", pa.int64()), ("h0", pa.int64()), ("h1", pa.int64())]))


def _rolled(carry: dict[int, tuple[int | None, int, int, int]]):
    def rolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, count, state, begun = None, 0, [0, 0], False
        for batch in batches:
            if not len(batch):
                continue
            table, ids, null, first = _arrays([batch])
            if not begun:
                conv, count, *state = carry.get(table.column("_part")[0].as_py(), (None, 0, 0, 0))
                begun = True
            if not count or conv != (None if null[0] else int(ids[0])):
                count, state = 0, [0, 0]
            hashes = [roll(table.column(f"k{k}").to_numpy().view(np.uint64), first, base, state[k]) for k, base in enumerate(_BASES)]
            at = np.arange(len(ids))
            pos = at - np.maximum.accumulate(np.where(first, at, 0))
            run = np.cumsum(first) == 1
            pos[run] += count
            conv, count, state = None if null[-1] else int(ids[-1]), int(pos[-1]) + 1, [int(h[-1]) for h in hashes]
            columns = [*(table.column(c).combine_chunks() for c in ("conv", "turn", "k0", "k1")), pa.array(pos), *(pa.array(h.view(np.int64)) for h in hashes)]
            yield from pa.table(columns, ["conv", "turn", "k0", "k1", "pos", "h0", "h1"]).to_batches()

    return rolled


def prefix_keys(turns: DataFrame) -> DataFrame:
    """(conv, turn, tie, k0, k1), rows distinct -> the same without tie, with pos (place in the conversation) and h0, h1 (key of the
    prefix that ends there)."""
    order = [F.col("conv").asc_nulls_last(), F.col("turn").asc_nulls_first(), "tie", "k0", "k1"]
    placed = durable(turns.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    carry, conv, n, state = {}, None, 0, (0, 0)
    schema = "_part int, conv long, whole boolean, n long, h0 long, h1 long"
    mask = (1 << 64) - 1
    for row in placed.mapInArrow(tidied(_ends), schema).orderBy("_part").collect():  # one row a partition
        carry[row["_part"]] = (conv, n, *state)
        joins = n and row["whole"] and row["conv"] == conv
        state = tuple(((state[k] * pow(int(base), row["n"], 1 << 64) if joins else 0) + row[f"h{k}"]) & mask for k, base in enumerate(_BASES))
        conv, n = row["conv"], row["n"] + (n if joins else 0)
    return placed.mapInArrow(tidied(_rolled(carry)), _ROLLED)


def _keyed(conversations: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    # turns of one number: by role, then by a hash that SQL has as well
    tie = F.concat(F.left("role", F.lit(ROLE)), F.lit("\0"), F.md5(F.concat("role", F.lit("\0"), "text").cast("binary")))
    return rows.withColumns({"tie": tie, "k0": F.xxhash64("role", "text"), "k1": F.xxhash64(F.lit(1), "text", "role")})


def maximal(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv, n_turns, n_equal) of the maximal conversations, the turns with their prefix keys)."""
    turns = durable(prefix_keys(_keyed(conversations).groupBy("conv", "turn", "tie", "k0", "k1").agg(F.lit(1).alias("_one")).drop("_one")))
    size = turns.groupBy("conv").agg(F.max(F.struct("pos", "h0", "h1")).alias("last"))
    ends = size.select("conv", "last.*").groupBy("pos", "h0", "h1").agg(F.min("conv").alias("conv"), F.count("*").alias("n_equal"))
    # rows before a conversation's last one: taken by subtracting, so that no conversation is gathered
    counted = turns.groupBy("pos", "h0", "h1").agg(F.count("*").alias("n"))
    classes = counted.join(ends, ["pos", "h0", "h1"])
    inner = counted.join(ends.select("pos", "h0", "h1", "n_equal"), ["pos", "h0", "h1"], "left").where(F.col("n") > F.coalesce("n_equal", F.lit(0))).select("pos", "h0", "h1")
    kept = classes.join(inner, ["pos", "h0", "h1"], "left_anti")
    return kept.select("conv", (F.col("pos") + 1).alias("n_turns"), "n_equal"), turns


def format_chats(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> conv_id, part, n_turns (of the whole conversation), n_equal (conversations that are
    just this one), text (the rendering)."""
    kept, turns = maximal(conversations)
    kept = durable(kept)
    wanted = turns.join(small_or_shuffled(kept.withColumnRenamed("conv", "_conv")), F.col("conv").eqNullSafe(F.col("_conv"))).drop("_conv")
    rows = _keyed(conversations)
    wanted = wanted.select(*(F.col(c).alias(f"_{c}") for c in ("conv", "turn", "k0", "k1")), "pos", "n_turns", "n_equal")
    same = (F.col("k0") == F.col("_k0")) & (F.col("k1") == F.col("_k1")) & F.col("conv").eqNullSafe(F.col("_conv")) & F.col("turn").eqNullSafe(F.col("_turn"))
    found = rows.join(wanted, same)
    said = F.concat(F.lit(OPEN), "role", F.lit(MIDDLE), "text", F.lit(CLOSE))
    parts = found.groupBy("conv", F.floor(F.col("pos") / PART).cast("int").alias("part"), "n_turns", "n_equal").agg(F.array_sort(F.collect_set(F.struct("pos", said.alias("said")))).alias("turns"))
    return parts.select(F.col("conv").alias("conv_id"), "part", "n_turns", "n_equal", F.array_join("turns.said", "").alias("text"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP3_SQL = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
c AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, left(role, 64) || chr(0) || md5(role || chr(0) || text)) AS turns FROM t GROUP BY conv_id),
e AS (SELECT turns, min(conv_id) AS conv_id, count(*) AS n_equal FROM c GROUP BY turns)
SELECT conv_id, CAST(p AS INTEGER) AS part, len(turns) AS n_turns, n_equal,
  array_to_string(list_transform(turns[p * 512 + 1 : p * 512 + 512], lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)), '') AS text
FROM e, unnest(range((len(turns) + 511) // 512)) AS u(p)
WHERE NOT EXISTS (SELECT 1 FROM e AS f WHERE f.turns[1] = e.turns[1] AND len(f.turns) > len(e.turns) AND f.turns[1 : len(e.turns)] = e.turns)
"""
