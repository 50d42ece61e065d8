"""Lists of albums that are merged anew whenever something changes: a stream of added photographs, batch by batch.

A kept list lies in the shared folder as one Parquet table a version: version n is the list after batch n, and holds as well what batch n did.
A batch reads the version before its own, appends the photographs that are not in the list yet, works out the actions that make what is
shown the new list, and asks which photograph to load next. A version appears as a whole, by a rename; a batch that is replayed
finds its version and changes nothing."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlux.operators import albums as A

#: Columns of a list: album, pos (from 0), photo_id and state.
LIST = "album long, pos int, photo_id string, state string"
ACTIONS = "album long, pos int, action string, photo_id string"


class KeptLists:
    """Versions of lists and of the actions that led to them, in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path = lambda name: path(f"{self.folder}/{name}")
        self._store = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def has(self, version: int) -> bool:
        return bool(self._store.exists(self._path(f"v{version}")))

    def lists(self, version: int) -> DataFrame:
        """The lists of a version; before the first one there are none."""
        return self.spark.read.schema(LIST).parquet(f"{self.folder}/v{version}/lists") if self.has(version) else self.spark.createDataFrame([], LIST)

    def actions(self, version: int) -> DataFrame:
        return self.spark.read.schema(ACTIONS).parquet(f"{self.folder}/v{version}/actions")

    def last(self) -> int:
        """The last version; -1 if there is none."""
        if not self._store.exists(self._path("")):
            return -1
        names = [s.getPath().getName() for s in self._store.listStatus(self._path(""))]
        return max((int(n[1:]) for n in names if n[0] == "v"), default=-1)

    def put(self, version: int, lists: DataFrame, write_actions: Callable[[DataFrame], DataFrame]) -> None:
        """Writes a version: the lists, and the actions that are worked out from them as written."""
        draft = f"draft-{uuid.uuid4().hex}"
        lists.write.parquet(f"{self.folder}/{draft}/lists")
        written = self.spark.read.schema(LIST).parquet(f"{self.folder}/{draft}/lists")
        write_actions(written).write.parquet(f"{self.folder}/{draft}/actions")
        if not self._store.rename(self._path(draft), self._path(f"v{version}")):
            raise OSError(f"version {version} can't be put in place")


def appended(have: DataFrame, added: DataFrame) -> DataFrame:
    """have (as LIST) with the added photographs (album, seq, photo_id, state) that it doesn't hold, behind its last ones by seq. Of rows that
    repeat a photograph within one batch all stay; a null photo_id is always new. A photograph that is held takes the newest state."""
    held = have.select(F.col("album").alias("_album"), F.col("photo_id").alias("_photo_id"))
    fresh = added.join(held, (F.col("album") == F.col("_album")) & (F.col("photo_id") == F.col("_photo_id")), "left_anti")
    news = added.where("photo_id is not null").groupBy("album", "photo_id").agg(F.max_by("state", "seq").alias("_state"))
    old = have.join(news, ["album", "photo_id"], "left").select("album", "pos", "photo_id", F.coalesce("_state", "state").alias("state"))
    sizes = have.groupBy("album").agg((F.max("pos") + 1).alias("_size"))
    # one batch's photographs of one album are numbered; lists themselves are not
    place = F.row_number().over(Window.partitionBy("album").orderBy("seq", "photo_id")) - 1
    behind = fresh.withColumn("_at", place).join(sizes, "album", "left").select("album", (F.coalesce("_size", F.lit(0)) + F.col("_at")).cast("int").alias("pos"), "photo_id", "state")
    return old.unionByName(behind)


def merge_batch(kept: KeptLists, added: DataFrame, batch: int, removed: DataFrame | None = None) -> None:
    """Takes a batch (album, seq, photo_id, state) into the lists. removed: albums (album) that are emptied first."""
    if kept.has(batch):
        return
    have = kept.lists(batch - 1)
    start = have if removed is None else have.join(removed.select("album").distinct(), "album", "left_anti")
    kept.put(batch, appended(start, added), lambda now: A.merged(have, now, "album", "pos", "photo_id"))


def merging(added: DataFrame, spark: SparkSession, folder: str, checkpoint: str):
    """Starts the stream that takes added photographs into the lists of a folder, all that is there; returns the query."""
    kept = KeptLists(spark, folder)
    return added.writeStream.foreachBatch(lambda rows, batch: merge_batch(kept, rows, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def next_to_load(kept: KeptLists, current: DataFrame) -> DataFrame:
    """(album, pos) of the photograph to load next after the last batch; current: album, pos of what is looked at."""
    return A.prefetch(kept.lists(kept.last()), current, "album", "pos", "state")
