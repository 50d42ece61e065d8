"""Mixing sources to target weights.

Tokens (or words) are summed per source, each source's target is derived from weights under a cap, and target / size is its repetition
rate: every document is emitted floor(rate) times, plus one copy if its hash-seeded uniform number is below the fraction (for one
seed, a Bernoulli copy of just that probability). Of SEEDS hash seeds each source takes the one whose copies come nearest its target;
that costs one more aggregation, brings sources near their targets, and conditions the draw: a document's probability is no longer
the fraction. Where few documents or a long one dominate a source the difference is large: the extra copy of a source's only
document is never emitted for a fraction clearly below 0.5, and always above, as far as the seeds hold both draws.

Targets: sources share TOTAL of all sizes by weight; none gets more than CAP times its own size, and what is over goes to the others
by weight until none is above its cap. That is target = min(CAP * size, level * weight) for one level, found exactly from running
sums over the sources in the order of size / weight.

Defined results: a null text has size 0; a null source is a source of its own, last in order; a source of size 0 has target 0; a
document of size 0 is emitted by the same draw as any other; draws depend on the seed, doc_id (null is one value) and the text, so
reruns agree and rows that repeat both get the same copies; an empty table gives an empty mix. Columns of docs are kept as they are.
Only ids, hashes and sizes are measured durably; texts stay where they are, as each row's copies follow from its source's rate and seed.
Per-source rows are joined by a broadcast if they are measured to be small, else by a shuffle, in which Spark splits a hot source
(adaptive skew join)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlux.llm._durable import WORD, durable, renamed, running_sums, small_or_shuffled

#: Fixed values of the production mixture.
WEIGHTS, TOTAL, CAP = (3, 1, 2), 1.5, 2.0
SEEDS = 64
_UNIT = float(1 << 53)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _uniform(seed: int) -> Column:
    """A number in [0, 1) from the seed, the id and the text."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "_doc", "_text_key"), 11) / F.lit(_UNIT)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """(source, source_size) -> with weight and target. Sources in code point order, null last, get the weights in turn."""
    ordered = running_sums(sizes, [F.col("source").asc_nulls_last()], {"_place": F.lit(1).cast("long")})
    weighted = ordered.withColumn("weight", F.get(F.array(*(F.lit(float(w)) for w in weights)), F.pmod("_place", F.lit(len(weights))).cast("int"))).drop("_place")
    by_ratio = durable(running_sums(weighted, [F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()], {"_size": F.col("source_size"), "_weight": F.col("weight")}))
    sums = by_ratio.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    size, weight = sums["size"] or 0, sums["weight"] or 0.0
    level = F.col("source_size") * cap / F.col("weight")
    full = by_ratio.where(F.col("_size") * cap + level * (F.lit(weight) - F.col("_weight")) <= total * size).agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    rest = weight - (full["weight"] or 0.0)
    height = (total * size - cap * (full["size"] or 0)) / rest if rest > 0 else float("inf")
    return by_ratio.select("source", "source_size", "weight", F.least(F.col("source_size") * cap, F.col("weight") * height).alias("target"))


def _sized(docs: DataFrame, size: Column | None) -> DataFrame:
    return durable(docs.select(F.col("doc_id").cast("long").alias("_doc"), F.xxhash64(F.col("text").cast("string")).alias("_text_key"), F.col("source").cast("string"), (words(F.col("text").cast("string")) if size is None else size).alias("size")))


def _drawn(sized: DataFrame, weights: tuple[int, ...], total: float, cap: float) -> DataFrame:
    """(_source, source_size, target, rate, seed) of each source."""
    by_source = durable(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, total, cap))
    rated = by_source.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).drop("weight")
    rated = rated.withColumnRenamed("source", "_source")
    fraction = F.col("rate") - F.floor("rate")
    drawn = _with_source(sized, rated, "source").groupBy("_source").agg(*(F.sum(F.when(_uniform(k) < fraction, F.col("size")).otherwise(0)).alias(f"s{k}") for k in range(SEEDS)))
    miss = lambda k: F.abs(F.col(f"s{k}") + F.floor("rate") * F.col("source_size") - F.col("target"))
    best = drawn.withColumnRenamed("_source", "_name").join(rated, F.col("_name").eqNullSafe(F.col("_source")))
    return durable(best.select("_source", "source_size", "target", "rate", F.array_min(F.array(*(F.struct(miss(k).alias("miss"), F.lit(k).alias("seed")) for k in range(SEEDS))))["seed"].alias("seed")))


def _with_source(rows: DataFrame, table: DataFrame, source: str) -> DataFrame:
    return rows.join(small_or_shuffled(table), F.col(source).cast("string").eqNullSafe(F.col("_source")))


def _copies(doc: Column, text_key: Column) -> Column:
    draw = F.shiftrightunsigned(F.xxhash64("seed", doc, text_key), 11) / F.lit(_UNIT)
    return (F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long")


def plan_mixture(docs: DataFrame, size: Column | None = None, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """One row for each row of docs (doc_id, text, source): doc_id, text_key, size, source, source_size, target, rate, copies, taken."""
    sized = _sized(docs, size)
    planned = _with_source(sized, _drawn(sized, weights, total, cap), "source").withColumn("copies", _copies(F.col("_doc"), F.col("_text_key")))
    return planned.select(F.col("_doc").alias("doc_id"), F.col("_text_key").alias("text_key"), "size", "source", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix_sources(docs: DataFrame, size: Column | None = None, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """The mix: each row of docs, all columns as they were, as many times as planned."""
    chosen = _drawn(_sized(docs, size), weights, total, cap)
    rows, at, back = renamed(docs)
    copies = _copies(F.col(at["doc_id"]).cast("long"), F.xxhash64(F.col(at["text"]).cast("string")))
    mixed = _with_source(rows, chosen, at["source"]).withColumn("_copies", copies).where("_copies > 0")
    return back(mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = plan_mixture(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")
