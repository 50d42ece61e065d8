"""Photographs in files of any file system that Spark reads, and what pictures they hold.

Paths without files give an error, as Spark gives it; Spark lists no files of no bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlux.functions import columns as C
from parlux.functions import media as M
from parlux.operators import albums as A
from parlux.operators import stereo

#: Types by the ending of a file's name; another ending gives an empty type.
TYPES = {"mpo": "image/mpo", "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp"}
#: The type of a stereo container and of each picture in it.
STEREO, PICTURE = "image/mpo", "image/jpeg"



def type_of(name: Column) -> Column:
    """The type that a file's name declares."""
    ending = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in TYPES.items() for x in pair)), ending), F.lit(""))


def photographs(spark: SparkSession, *paths: str, pattern: str = "*") -> DataFrame:
    """Files as path, name, mime and content, one row each."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(list(paths))
    name = F.try_url_decode(F.element_at(F.split("path", "/"), -1))
    return files.select("path", name.alias("name"), type_of(name).alias("mime"), "content")


def uploaded(files: DataFrame) -> DataFrame:
    """The album that files make up: place (from 1, by path), photo_id (null), path, name and mime. Contents stay where they are."""
    return A.unique_ids(files.select(F.lit(None).cast("string").alias("photo_id"), "path", "name", "mime"), ["path"], "place")


def classified(files: DataFrame) -> DataFrame:
    """files (path, name, mime, content) with what they show: images (places and sizes of pictures in the content), parallax and error.

    A file that may be a stereo container is parsed: a sound one is of that type and has two images; one that isn't sound is one image,
    but an error (and no image) if it declares no type or the container's. All other files are one image, not looked at. Null content
    counts as empty."""
    rows = files.select("path", "name", "mime", "content").withColumn("_asked", F.coalesce(C.maybe_stereo(F.col("mime"), F.col("name")), F.lit(False)))
    # contents of candidates alone go through Python, what comes back are places; with its length beside it, content need not travel where nobody asks for it
    seen = rows.withColumn("_size", F.coalesce(F.octet_length("content"), F.lit(0)))
    seen = stereo.with_stereo(seen, F.when(F.col("_asked"), F.col("content"))).withColumn("_found", F.when(F.col("_asked"), F.col("stereo")))
    sound = F.col("_found").isNotNull() & F.col("_found.error").isNull()
    declared = F.coalesce("mime", F.lit(""))
    failed = F.col("_found.error").isNotNull() & declared.isin("", STEREO)
    image = lambda start, size: F.struct(start.cast("long").alias("start"), size.cast("long").alias("size"))
    two = F.array(*(image(F.col(f"_found.start{k}"), F.col(f"_found.size{k}")) for k in range(2)))
    one = F.array(image(F.lit(0), F.col("_size")))
    return seen.select("path", "name", F.when(sound, STEREO).otherwise(F.col("mime")).alias("mime"), "content", F.when(sound, two).when(~failed, one).alias("images"), "_found.parallax", F.when(failed, F.col("_found.error")).alias("error"))


def pictures(seen: DataFrame) -> DataFrame:
    """classified's images one a row: path, number (from 0), mime and content; a container's pictures end with their end marker."""
    rows = seen.select("path", "mime", "content", F.posexplode("images").alias("number", "_at"))
    part = F.substr("content", (F.col("_at.start") + 1).cast("int"), F.col("_at.size").cast("int"))
    inside = F.col("mime") == STEREO
    return rows.select("path", "number", F.when(inside, PICTURE).otherwise(F.col("mime")).alias("mime"), F.when(inside, M.with_end(part)).otherwise(part).alias("content"))


def picture_urls(seen: DataFrame) -> DataFrame:
    """Each file's pictures as data URLs, in order: path, mime, urls and parallax; null urls where there is an error."""
    mime = F.when(F.col("mime") == STEREO, PICTURE).otherwise(F.coalesce("mime", F.lit("")))
    part = lambda at: F.substr("content", (at["start"] + 1).cast("int"), at["size"].cast("int"))
    return seen.select("path", "mime", F.transform("images", lambda at: C.data_url(mime, part(at))).alias("urls"), "parallax", "error")
