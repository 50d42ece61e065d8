"""Files on disk, classified; pictures taken out of containers; loads as a stream."""

import base64
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from parlux.plans.loading import SAMPLE
from parlux.sources import files, written
from parlux.streaming import flows


def test_photographs(spark, tmp_path):
    cases = {"a b.MPO": SAMPLE, "c.jpg": SAMPLE, "d.mpo.jpg": SAMPLE + b"x", "e.mpo": b"broken", "f.png": b"\x89PNG", "g": b"", "h": SAMPLE}
    for name, content in cases.items():
        (tmp_path / name).write_bytes(content)
    found = files.photographs(spark, str(tmp_path))
    album = files.uploaded(found).orderBy("place").collect()
    del cases["g"]  # files of no bytes are not listed
    assert [(r.place, r.photo_id, r.name, r.mime) for r in album] == [(k, None, n, m) for k, (n, m) in enumerate(zip(cases, ["image/mpo", "image/jpeg", "image/jpeg", "image/mpo", "image/png", ""], strict=True), 1)]
    seen = files.classified(found)
    got = {r.name: r for r in seen.collect()}
    assert {n: (r.mime, r.images and len(r.images), r.error is None) for n, r in got.items()} == {"a b.MPO": ("image/mpo", 2, True), "c.jpg": ("image/jpeg", 1, True), "d.mpo.jpg": ("image/mpo", 2, True), "e.mpo": ("image/mpo", None, False), "f.png": ("image/png", 1, True), "h": ("image/mpo", 2, True)}
    start, size = got["h"].images[1]
    assert start + size == len(SAMPLE) and got["f.png"].images == [(0, 4)]
    urls = {r.path.rsplit("/", 1)[1]: r.urls for r in files.picture_urls(seen).collect()}
    assert [base64.b64decode(u.removeprefix("data:image/jpeg;base64,")) for u in urls["h"]] == [SAMPLE[:start], SAMPLE[start:]] and urls["e.mpo"] is None
    parts = files.pictures(seen.where("name = 'h'"))
    rows = parts.select(F.col("number").cast("string").alias("doc"), F.array("number").alias("path"), F.col("content").alias("part"))
    written.write_parts(rows, f"file://{tmp_path}/out", ".jpg")
    assert {p.stem: p.read_bytes() for p in (tmp_path / "out").glob("*/*")} == {"0": SAMPLE[:start] + b"\xff\xd9", "1": SAMPLE[start:] + b"\xff\xd9"}
    assert files.photographs(spark, str(tmp_path), pattern="*.png").count() == 1


def test_odd_files(spark):
    rows = [("1", None, None, None), ("2", "x.jpg", "image/jpeg", None), ("3", None, "image/png", b"")]
    got = {r.path: r for r in files.classified(spark.createDataFrame(rows, "path string, name string, mime string, content binary")).collect()}
    assert got["1"].error and got["1"].images is None and got["2"].images == [(0, 0)] and got["3"].images == [(0, 0)]


def test_classified_without_join(spark):
    """Candidates are parsed in their own rows: equal paths may repeat, and contents go nowhere."""
    rows = [("same", "a.mpo", "image/mpo", SAMPLE), ("same", "b.mpo", "", b"broken"), ("same", "c.png", "image/png", SAMPLE)]
    seen = files.classified(spark.createDataFrame(rows, "path string, name string, mime string, content binary"))
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert {r.name: (r.images and len(r.images), r.error is None) for r in seen.collect()} == {"a.mpo": (2, True), "b.mpo": (None, False), "c.png": (1, True)}


def test_load_stream(spark, tmp_path):
    begin = datetime(2024, 1, 1)
    rows = [(1, "asked", 0), (1, "done", 1), (1, "failed", 2), (2, "asked", 0), (3, "other", 0), (4, "asked", 0), (4, "failed", 3), (5, None, None), (6, "asked", 0), (6, "failed", 1), (6, "done", 1)]
    spark.createDataFrame([(k, e, s if s is None else begin + timedelta(seconds=s)) for k, e, s in rows], "id int, event string, ts timestamp").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id int, event string, ts timestamp").parquet(f"{tmp_path}/in")
    flows.load_states(stream, "id", "event", "ts").writeStream.format("memory").queryName("loads").outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(120)
    assert {tuple(r) for r in spark.table("loads").collect()} == {(1, "LOADED"), (2, "LOADING"), (3, "PENDING"), (4, "ERROR"), (5, "PENDING"), (6, "LOADED")}
