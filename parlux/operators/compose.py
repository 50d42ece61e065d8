"""Two pictures of a stereo photograph side by side on one canvas, as tables of pixels.

What the parallax takes away is cut off, the rest is made smaller where it is higher or wider than allowed. A target pixel is the mean of
the source pixels that it covers, each by the area that it has in it; areas are whole numbers (a side of a source pixel counts as many
units as the target has pixels), so they add up exactly. As pictures are only made smaller, a source pixel lies in four target pixels at
most: each row is told which, and the targets are sums that combine before their shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlux.operators.shared import small_or_shuffled

#: The largest picture of one eye.
MAX_WIDTH, MAX_HEIGHT = 1920, 1080


def fitted(width: Column, height: Column, parallax: Column, max_width: int = MAX_WIDTH, max_height: int = MAX_HEIGHT) -> tuple[Column, Column, Column]:
    """(clipped, target width, target height) of each picture: what the parallax leaves of its width, made to fit by height, then by width."""
    clipped = width - F.abs(parallax)
    tall = height > max_height
    w, h = F.when(tall, F.floor(max_height * clipped / height)).otherwise(clipped), F.when(tall, F.lit(max_height)).otherwise(height)
    wide = w > max_width
    return clipped, F.when(wide, F.lit(max_width)).otherwise(w).cast("int"), F.when(wide, F.floor(max_width * h / w)).otherwise(h).cast("int")


def _shares(at: Column, source: Column, target: Column) -> Column:
    """array<struct(to, share)> of the target pixels that a source pixel lies in, of source pixels made target ones; shares of a source pixel
    sum to target, those of a target pixel to source."""
    first, last = F.floor(at * target / source), F.floor(((at + 1) * target - 1) / source)
    overlap = lambda k: F.least((at + 1) * target, (k + 1) * source) - F.greatest(at * target, k * source)
    return F.transform(F.sequence(first, last), lambda k: F.struct(k.cast("int").alias("to"), overlap(k).cast("long").alias("share")))


def side_by_side(pixels: DataFrame, pictures: DataFrame, key: str, channels: list[str], max_width: int = MAX_WIDTH, max_height: int = MAX_HEIGHT) -> DataFrame:
    """pixels (key, eye: 0 is left, x, y, channels) of pictures (key, width, height, parallax: whole pixels) -> (key, x, y, channels).

    A parallax above 0 cuts the left picture's left edge off, one below 0 the right one's; both lose the same width. Pictures of which
    nothing is left have no rows. pictures is broadcast if it is measured to be small."""
    clipped, w, h = fitted(F.col("width"), F.col("height"), F.col("parallax"), max_width, max_height)
    sizes = pictures.select(key, "height", "parallax", clipped.cast("int").alias("_clipped"), w.alias("_w"), h.alias("_h")).where("_clipped > 0 and _w > 0 and _h > 0")
    rows = pixels.join(small_or_shuffled(sizes), key)
    cut = F.when((F.col("parallax") > 0) & (F.col("eye") == 0), F.col("parallax")).when((F.col("parallax") < 0) & (F.col("eye") == 1), -F.col("parallax")).otherwise(0)
    rows = rows.withColumn("_x", F.col("x") - cut).where("_x >= 0 and _x < _clipped and y >= 0 and y < height")
    rows = rows.withColumn("_across", F.explode(_shares(F.col("_x"), F.col("_clipped"), F.col("_w")))).withColumn("_down", F.explode(_shares(F.col("y"), F.col("height"), F.col("_h"))))
    area, whole = F.col("_across.share") * F.col("_down.share"), F.first("_clipped").cast("long") * F.first("height")
    place = [key, (F.col("_across.to") + F.when(F.col("eye") == 1, F.col("_w")).otherwise(0)).alias("x"), F.col("_down.to").alias("y")]
    mean = lambda c: F.floor((2 * F.sum(F.col(c) * area) + whole) / (2 * whole)).cast("int").alias(c)
    return rows.groupBy(*place).agg(*(mean(c) for c in channels))
