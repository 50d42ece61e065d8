"""Containers against known places of their parts, byte by byte."""

import struct

import pytest
from pyspark.sql import functions as F

from parlux.operators import muxer as M
from parlux.operators import relational as R
from parlux.sources import written as W

#: Places and payload sizes of header, segment, seek head, info, tracks, cluster and cues, the seek positions, and the files' lengths.
FIRST = {"parts": [(0, 32), (38, 19440), (45, None), (131, None), (175, None), (230, 19147), (19384, 95)], "seeks": [86, 130, 185, 19339], "times": [0, 20, 50, 90, 140], "bytes": 19485}
SECOND = {"parts": [(0, 32), (38, 17672), (45, None), (131, None), (175, None), (234, 17371), (17612, 99)], "seeks": [86, 130, 189, 17567], "times": [0, 100, 250, 450, 700], "bytes": 17717}


def made(spark):
    lengths = {1: [3720, 3790, 3894, 3856, 3864], 2: [3240, 3618, 3632, 3618, 3240]}
    durations = {1: [20, 30, 40, 50, 60], 2: [100, 150, 200, 250, 300]}
    rows = [(d, k, durations[d][k], bytes([d, k]) * ((n - 4) // 2)) for d, ns in lengths.items() for k, n in enumerate(ns)]
    frames = spark.createDataFrame(rows, "doc int, idx int, duration int, data binary")
    timed = R.clusters(frames, ["doc"], ["idx"], F.col("duration"), M.CLUSTER_MS).join(frames, ["doc", "idx"]).persist()
    videos = spark.createDataFrame([(1, 150, 150, False), (2, 300, 150, True)], "doc int, width int, height int, stereo boolean")
    return M.video_nodes(videos, timed, app="abcde")


def test_places(spark, tmp_path):
    tree = made(spark).persist()
    nodes = M.laid_out(tree).orderBy("doc", "path").collect()
    parts, errors = M.file_parts(tree)
    assert errors.count() == 0
    W.write_parts(parts, f"file://{tmp_path}/out")
    files = {int(p.stem): p.read_bytes() for p in (tmp_path / "out").glob("*/*.webm")}
    assert len(files) == 2 and not (tmp_path / "out" / W.DRAFTS).exists()
    for doc, want in ((1, FIRST), (2, SECOND)):
        mine = [r for r in nodes if r.doc == doc]
        top = {tuple(r.path): r for r in mine if len(r.path) <= 2 and r.payload is None}
        assert [(r.place, r.size if size else None) for r, (_, size) in zip(top.values(), want["parts"], strict=True)] == want["parts"]
        assert [int.from_bytes(r.payload, "big") for r in mine if r.id == M.SEEK_POSITION] == want["seeks"]
        assert [int.from_bytes(r.payload, "big") for r in mine if r.id == M.CUE_TIME] == want["times"]
        data = files[doc]
        assert len(data) == want["bytes"]
        for r in mine:
            assert data[r.place :].startswith(bytes.fromhex(f"{r.id:x}".zfill(len(f"{r.id:x}") + len(f"{r.id:x}") % 2)))
            if r.payload is not None:
                assert data[r.place + r.head : r.place + r.head + r.size] == bytes(r.payload)
        assert struct.pack(">d", {1: 200, 2: 1000}[doc]) in data


def test_numbers(spark):
    values = [0.0, 1.0, -2.5, 200.0, 1 / 3, 1e300, -7e-200, 123456789.125]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", M.double(F.col("v")).alias("b")).collect()
    assert [bytes(r.b) for r in got] == [struct.pack(">d", r.v) for r in got]
    bits = ["1", "101", "11111111", "100000000", "0000000000000001"]
    got = spark.createDataFrame([(b,) for b in bits], "s string").select("s", M.bit_string(F.col("s")).alias("b")).collect()
    assert [bytes(r.b) for r in got] == [int(r.s, 2).to_bytes(-(-len(r.s) // 8), "big") for r in got]


def test_frames(spark):
    def webp(w, h, riff=b"RIFF", off=0, marker=b"\x9d\x01\x2a"):
        body = b"WEBPVP8 " + struct.pack("<I", 13) + b"\0\0\0" + marker + struct.pack("<HH", w, h) + b"rest"
        return riff + struct.pack("<I", len(body) + off) + body

    cases = {"fine": (webp(5, 7), True), "riff": (webp(5, 7, b"RIFX"), False), "length": (webp(5, 7, off=1), False), "marker": (webp(5, 7, marker=b"abc"), False), "size": (webp(6, 7), False), "scale": (webp(5 | 1 << 14, 7), False), "short": (b"RIFF", False), "none": (None, False)}
    df = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "name string, webp binary")
    got = {r.name: r.v for r in df.select("name", M.vp8_frame(F.col("webp"), F.lit(5), F.lit(7)).alias("v")).collect()}
    assert {k: v is not None for k, v in got.items()} == {k: v[1] for k, v in cases.items()} and bytes(got["fine"]) == cases["fine"][0][20:]


def test_frames_to_files(spark, tmp_path):
    """Frames of several clusters; videos that can't be made are told why."""

    def webp(w, h, n):
        body = b"WEBPVP8 " + struct.pack("<I", n) + b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", w, h) + b"d" * n
        return b"RIFF" + struct.pack("<I", len(body)) + body

    frame = lambda doc, idx, ms=None, w=5, h=7, stereo=False, data=True: (doc, idx, ms, w, h, stereo, webp(w, h, idx + 9) if data else b"x")
    rows = [frame("long/1", k, 7_000) for k in range(12)] + [frame("b", 0), frame("b", 1, 40)] + [frame("width", 0), frame("width", 1, w=6), frame("stereo", 0), frame("stereo", 1, stereo=True), frame("still", 0, 0), frame("still", 1, 5), frame("bad", 0, data=False), frame("none", 0, w=None, data=False), frame("two", 0, h=7), frame("two", 1, h=8)]
    df = spark.createDataFrame(rows, "doc string, idx int, duration int, width int, height int, stereo boolean, webp binary").repartition(3)
    videos, frames = M.checked_frames(df)
    errors = {r.doc: r.error for r in videos.collect()}
    assert errors == {"long/1": None, "b": None, "width": "frames of several widths", "stereo": "stereo frames among others", "still": "a frame without duration", "bad": "a frame is no key frame of its size", "none": "frames of several widths", "two": "frames of several heights"}
    timed = {(r.doc, r.idx): (r.cluster, r.time) for r in frames.collect()}
    assert timed["long/1", 4] == (0, 28_000) and timed["long/1", 5] == (1, 0) and timed["long/1", 10] == (2, 0) and timed["b", 1] == (0, 1000)
    parts, broken = M.file_parts(M.video_nodes(videos.where("error is null"), frames))
    W.write_parts(parts, f"file://{tmp_path}/out")
    files = {p.name: p.read_bytes() for p in (tmp_path / "out").glob("*/*")}
    assert set(files) == {"long%2F1.webm", "b.webm"} and broken.count() == 0
    assert files["long%2F1.webm"].count(bytes.fromhex("1f43b675")) == 3 + 3  # clusters, and their places among the seeks


def test_unsound_trees(spark):
    none = None
    rows = [("fine", [1], M.SEEK, none, none, none), ("fine", [1, 1], M.BLOCK, b"a", none, none), ("empty", [1], M.SEEK, none, none, none), ("lost", [1], M.SEEK, none, none, none), ("lost", [1, 1], M.SEEK_POSITION, none, [9], [1]), ("blank", [1], M.BLOCK, b"", none, none)]
    parts, errors = M.file_parts(spark.createDataFrame(rows, "doc string, path array<int>, id long, payload binary, target array<int>, origin array<int>"))
    assert {tuple(r) for r in errors.collect()} == {("empty", "an element has no content"), ("lost", "a position can't be told"), ("blank", "an element has no content")}
    assert b"".join(bytes(r.part) for r in parts.orderBy("path").collect()) == bytes.fromhex("4dbb" "4003" "a3" "81" "61")[: sum(len(r.part) for r in parts.collect())] or parts.count() == 2
    assert M.file_parts(made(spark).where("false"))[0].count() == 0


def test_writer_leaves_nothing_behind(spark, tmp_path):
    """A failing task leaves no file; parts that are not together are an error; a batch that comes again changes nothing."""
    rows = [(f"d{k}", [p], bytes([p]) * 3) for k in range(20) for p in range(1, 4)]
    good = spark.createDataFrame(rows, "doc string, path array<int>, part binary")
    out = f"file://{tmp_path}/out"
    for bad in (good.union(spark.createDataFrame([("d7", [9], None)], good.schema)), good.union(spark.createDataFrame([(None, [1], b"x")], good.schema))):
        with pytest.raises(Exception, match="a part without"):
            W.write_parts(bad, out)
    assert not list((tmp_path / "out").glob("*/*")) and not (tmp_path / "out" / W.DRAFTS).exists()
    apart = good.where("doc in ('d1', 'd2')").coalesce(1).sortWithinPartitions("path", "doc")
    with pytest.raises(Exception, match="not together"):
        apart.write.format("container_files").mode("append").save(out)
    with pytest.raises(Exception, match="append"):
        good.write.format("container_files").mode("overwrite").save(out)
    W.write_parts(good, out, ".bin")
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").glob("*/*")} == {f"d{k}.bin": b"\1\1\1\2\2\2\3\3\3" for k in range(20)}
    good.coalesce(1).write.parquet(f"{tmp_path}/in")
    for again in range(2):  # without its checkpoint a stream begins with batch 0 anew
        stream = spark.readStream.schema(good.schema).parquet(f"{tmp_path}/in").coalesce(1)
        query = stream.writeStream.format("container_files").option("path", f"file://{tmp_path}/streamed").option("checkpointLocation", f"{tmp_path}/c{again}").trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        files = sorted((tmp_path / "streamed").glob("*/*"))
        assert len(files) == 20 and {p.parent.name for p in files} == {"batch-0-00000"} and files[0].read_bytes() == b"\1\1\1\2\2\2\3\3\3"


def test_sums_over_partitions(spark):
    rows = [("hot", k, k % 5) for k in range(3000)] + [(f"g{k % 40}", k, 1) for k in range(400)]
    got = R.sum_before(spark.createDataFrame(rows, "g string, k int, v int").repartition(6), "g", "k", F.col("v"), "before").collect()
    total = {}
    want = {}
    for g, k, v in sorted(rows):
        want[g, k] = total.get(g, 0)
        total[g] = want[g, k] + v
    assert {(r.g, r.k): r.before for r in got} == want and len(got) == len(rows)
