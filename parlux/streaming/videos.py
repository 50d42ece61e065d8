"""Videos that are built as their frames come: frames are put aside batch by batch, and a video is written once its last one is there.

Frames lie in the shared folder by batch and by bucket of their video, so that a batch in which videos end reads their buckets alone. A batch
that comes again overwrites what it put aside and finds its files in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlux.operators import muxer as X
from parlux.sources.written import ContainerFiles, by_document

#: Parts of the frames that are put aside.
BUCKETS = 64
FRAMES = "doc string, idx int, duration int, width int, height int, stereo boolean, webp binary, last boolean"


def take_batch(frames: DataFrame, batch: int, aside: str, folder: str) -> None:
    """Puts a batch of frames (as FRAMES) aside and writes the videos that end in it into the folder; errors of those that can't be made are
    put aside as well (doc, error)."""
    spark = frames.sparkSession
    rows = frames.withColumn("bucket", F.pmod(F.xxhash64("doc"), F.lit(BUCKETS)).cast("int"))
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{aside}/frames/batch={batch}")
    written = spark.read.schema(f"{FRAMES}, batch int, bucket int").parquet(f"{aside}/frames").where(F.col("batch") <= batch)
    ended = written.where((F.col("batch") == batch) & F.col("last")).select("doc", "bucket").distinct()
    buckets = [r.bucket for r in ended.select("bucket").distinct().collect()]  # BUCKETS at most
    if not buckets:
        return
    mine = written.where(F.col("bucket").isin(buckets)).join(ended.select("doc"), "doc", "left_semi")
    videos, sound = X.checked_frames(mine.select(*(f.split()[0] for f in FRAMES.split(", ")[:-1])))
    parts, broken = X.file_parts(X.video_nodes(videos.where("error is null"), sound))
    videos.where("error is not null").select("doc", "error").unionByName(broken.select("doc", "error")).write.mode("overwrite").parquet(f"{aside}/errors/batch={batch}")
    spark.dataSource.register(ContainerFiles)
    by_document(parts).write.format("container_files").option("name", f"batch-{batch}").mode("append").save(folder)


def errors(spark: SparkSession, aside: str) -> DataFrame:
    """(doc, error, batch) of the videos that could not be made."""
    return spark.read.schema("doc string, error string, batch int").parquet(f"{aside}/errors")


def build(frames: DataFrame, aside: str, folder: str, checkpoint: str):
    """Starts the stream that builds videos of frames (as FRAMES), all that are there; returns the query."""
    return frames.writeStream.foreachBatch(lambda rows, batch: take_batch(rows, batch, aside, folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
