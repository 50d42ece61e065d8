"""Recorded service answers and streams, with odd rows among them."""

import json
from datetime import datetime, timedelta

from parlux.sources import services as S
from parlux.streaming import flows


def test_folders(spark):
    meta = [{"id": "f", "title": "Trip"}, {"id": "b", "title": "B", "mimeType": "image/jpeg"}, {"id": "a", "title": "A", "mimeType": "image/mpo"}, {"id": "t", "title": "0", "mimeType": "text/plain"}, {"id": "g", "title": "Other"}]
    lists = [("f", json.dumps({"items": [{"id": x} for x in "bat"]})), ("g", json.dumps({"items": [{"id": "a"}, {"id": "gone"}]})), ("h", None), ("e", json.dumps({"items": []}))]
    albums, photos = S.folder_albums(spark.createDataFrame(lists, "folder_id string, answer string"), spark.createDataFrame([(json.dumps(m),) for m in meta] + [("no json",), (None,)], "answer string"))
    assert {tuple(r) for r in albums.collect()} == {("f", "Trip", True), ("g", "Other", False), ("e", S.UNKNOWN, False)}
    assert [(r.place, r.photo_id) for r in photos.orderBy("place").collect()] == [(1, "a"), (2, "b")]


def test_picked(spark):
    urls = ["https://picasaweb.google.com/12/Trip?authkey=K", "https://picasaweb.google.com/joe/Trip", "https://plus.google.com/photos/12/albums/34"]
    docs = [("docs", S.FOLDER, "1", None), ("docs", "image/jpeg", "2", None), ("docs", "text/plain", "3", None), ("picasa", S.ALBUM, "4", urls[0]), ("picasa", S.ALBUM, "5", urls[1]), ("picasa", S.PHOTO, "6", urls[0]), ("else", "image/jpeg", "7", None), ("picasa", S.ALBUM, "", urls[2])]
    items = [dict(zip(("serviceId", "mimeType", "id", "url"), d, strict=True)) | {"name": "n", "thumbnails": [{"width": "32px", "height": "", "url": "u"}]} for d in docs]
    rows = [(1, json.dumps({"action": "picked", "docs": items})), (2, json.dumps({"action": "cancel", "docs": items})), (3, None), (4, "{")]
    got = S.picked(spark.createDataFrame(rows, "answer_id int, answer string")).orderBy("pos").collect()
    assert [r.kind for r in got] == ["folder", "file", None, "album", None, "photo", None, "album"]
    assert tuple(got[3].album) == ("12", "Trip", "4", "K") and tuple(got[7].album) == ("12", "34", "12", None)
    assert tuple(got[0].thumbnails[0]) == (32, None, "u")


def test_relay(spark):
    urls = ["https://lh3.googleusercontent.com/x", "https://picasaweb.google.com/", "http://picasaweb.google.com/x", "https://example.net/x", None]
    assert [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(S.relay_allowed(S.F.col("u"))).collect()] == [True, True, False, False, False]


def test_streams(spark, tmp_path):
    begin = datetime(2024, 1, 1)
    rows = [(k, begin + timedelta(seconds=s), t) for k, s, t in [(1, 0, 5), (1, 2, 9), (2, 1, None), (2, 40, 7)]]
    spark.createDataFrame(rows, "id int, ts timestamp, total int").write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("id int, ts timestamp, total int").parquet(f"{tmp_path}/in")
    for name, df, mode in (("prog", flows.progress(stream().withColumn("loaded", S.F.col("total")), "id", "loaded", "total", "ts"), "update"), ("pairs", flows.correlate(stream().where("total = 5 or total is null"), stream().where("total in (9, 7)"), "id", "10 seconds"), "append")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination(120)
    assert {tuple(r) for r in spark.table("prog").collect()} == {(1, 9, 9), (2, 7, 7)}
    assert [(r.request_id, r.response_total) for r in spark.table("pairs").collect()] == [(1, 9)]
