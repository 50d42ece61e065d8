"""Folders that driver and executors share, for tables that outlive a job."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of up to so many bytes (texts and some for each field) may be broadcast.
BROADCAST_BYTES = 16 << 20


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, by URI. Only where that is unset and all runs on this machine, a temporary folder takes its place."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="parlux-")
        spark.sparkContext.setCheckpointDir(named)
    return (named if re.match(r"\w+:", named) else f"file://{named}").rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and kept by checkpoint() in the shared folder."""
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()


def small_or_shuffled(df: DataFrame) -> DataFrame:
    """df, a kept table, with a broadcast hint if it is measured to have at most BROADCAST_BYTES; else it is joined by a shuffle."""
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    size = df.agg(F.sum(sum(texts, F.lit(16 * len(df.columns)).cast("long")))).first()[0]
    return F.broadcast(df) if (size or 0) <= BROADCAST_BYTES else df
