"""Tokens of blocks as a table, and the probabilities that fit them. No coder is needed for that: what would be coded of a block's levels is a
set of yes-or-no decisions, each of which depends on the level before it and, for the first one, on the blocks to the left and above.

A decision is a row: type (of the block), band (of the level's place), context (how large the level before was; of the first one, how many
of the two neighbours have levels), place (which decision of the tree it is, 0 to 10) and bit. Counts of ones and of all are an
aggregation over these four keys, which combines before its shuffle to at most 4 x 8 x 3 x 11 rows a picture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlux.operators import blocks as B

#: The band of each place in coding order.
BANDS = [0, 1, 2, 3, 6, 4, 5, 6, 6, 6, 6, 6, 6, 6, 6, 7]
#: Bits of a probability that is written, in 256ths of a bit.
WRITTEN = 8 * 256


def _tree(size: Column) -> Column:
    """array<struct(place, bit)> of a level of 2 or more: small ones (to 4) or a class of sizes, each class twice as wide as the one before."""
    row = lambda place, bit: F.struct(F.lit(place).alias("place"), bit.cast("int").alias("bit"))
    small = F.array(row(3, size > 4), row(4, size > 2))
    three = F.array(row(5, size > 3))
    wide = F.array(row(3, size > 4), row(6, size > 10))
    middle, large = F.array(row(7, size > 6)), F.array(row(8, size > 34))
    return F.when(size == 2, small).when(size <= 4, F.concat(small, three)).when(size <= 10, F.concat(wide, middle)).when(size <= 34, F.concat(wide, large, F.array(row(9, size > 18)))).otherwise(F.concat(wide, large, F.array(row(10, size > 66))))


def contexts(blocks: DataFrame, keys: list[str], levels: str, first: int = 0) -> DataFrame:
    """Blocks (keys, x, y, levels in coding order) with context: how many of the blocks on the left and above have levels that are not 0."""
    coded = blocks.withColumn("_coded", (B.last_level(F.col(levels), first) >= first).cast("int"))
    near = B.beside(coded, keys, ["_coded"])
    return near.withColumn("context", F.coalesce("left__coded", F.lit(0)) + F.coalesce("top__coded", F.lit(0))).drop("_coded", "left__coded", "top__coded")


def decisions(blocks: DataFrame, keep: list[str], levels: str, context: str, first: int = 0) -> DataFrame:
    """(keep, band, context, place, bit): a row for each decision of each block."""
    band = lambda n: F.get(F.array(*(F.lit(b) for b in BANDS)), n)
    rows = blocks.select(*keep, F.col(levels).alias("_v"), F.col(context).alias("_c"), B.last_level(F.col(levels), first).alias("_last"))
    at = rows.where(F.col("_last") >= first).select(*keep, "_v", "_c", "_last", F.explode(F.sequence(F.lit(first), F.col("_last"))).alias("_n"))
    size = lambda n: F.abs(F.get("_v", n))
    at = at.select(*keep, "_n", size(F.col("_n")).alias("_size"), F.when(F.col("_n") > first, size(F.col("_n") - 1)).alias("_before"), "_c")
    at = at.withColumn("context", F.when(F.col("_before").isNull(), F.col("_c")).otherwise(F.least("_before", F.lit(2))).cast("int"))
    one = lambda place, bit: F.struct(F.lit(place).alias("place"), (bit if isinstance(bit, Column) else F.lit(bit)).cast("int").alias("bit"))
    none = F.array().cast("array<struct<place:int,bit:int>>")
    # behind a 0 nobody asks whether there is more
    more = F.when(F.col("_before").isNull() | (F.col("_before") > 0), F.array(one(0, 1))).otherwise(none)
    value = F.when(F.col("_size") == 0, F.array(one(1, 0))).otherwise(F.array(one(1, 1), one(2, F.col("_size") > 1)))
    tree = F.when(F.col("_size") > 1, _tree(F.col("_size"))).otherwise(none)
    inside = at.select(*keep, band(F.col("_n")).alias("band"), "context", F.inline(F.concat(more, value, tree)))
    # where the levels end, if not at the last place
    end = F.greatest(F.col("_last") + 1, F.lit(first))
    before = F.when(end > first, F.least(size(end - 1), F.lit(2))).otherwise(F.col("_c"))
    ends = rows.where((F.col("_last") < 15)).select(*keep, band(end).alias("band"), before.cast("int").alias("context"), F.lit(0).alias("place"), F.lit(0).alias("bit"))
    return inside.unionByName(ends)


def token_counts(rows: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, band, context, place, ones, total) of decisions."""
    return rows.groupBy(*keep, "band", "context", "place").agg(F.sum("bit").alias("ones"), F.count("*").alias("total"))


def bit_cost(bit: int, probability: Column) -> Column:
    """256ths of a bit that a decision costs, of which 0 has a probability of 256ths: the entropy, rounded."""
    share = probability if not bit else 255 - probability
    return F.round(-256 * F.log2(F.greatest(share, F.lit(1)) / 256.0)).cast("long")


def chosen_probabilities(counts: DataFrame, defaults: DataFrame, keys: list[str]) -> DataFrame:
    """counts (keys, ones, total) of decisions with defaults (keys; old: the probability so far, update: that it stays) -> keys, fitted,
    renewed and probability: the fitted one where it saves more bits than writing it costs. Decisions that never occur keep theirs."""
    rows = defaults.join(counts, keys, "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("ones", "total")})
    fitted = F.when(F.col("ones") > 0, 255 - F.floor(F.col("ones") * 255 / F.col("total"))).otherwise(255).cast("int")
    rows = rows.withColumn("fitted", fitted)
    cost = lambda p: F.col("ones") * bit_cost(1, p) + (F.col("total") - F.col("ones")) * bit_cost(0, p)
    saved = cost(F.col("old")) + bit_cost(0, F.col("update")) - cost(F.col("fitted")) - bit_cost(1, F.col("update")) - WRITTEN
    rows = rows.withColumn("renewed", saved > 0)
    return rows.select(*keys, "ones", "total", "fitted", "renewed", F.when(F.col("renewed"), F.col("fitted")).otherwise(F.col("old")).alias("probability"))
