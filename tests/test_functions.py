"""Column functions by their values, and small operators: links, texts, bytes, layouts, transforms, and streams of videos."""

import random
import struct

from pyspark.sql import functions as F

from parlux.functions import columns as C
from parlux.functions import media as M
from parlux.operators import albums as A
from parlux.operators import blocks as B
from parlux.operators import compose as P
from parlux.operators import relational as R
from parlux.streaming import videos


def values(spark, rows, schema, *columns):
    """The columns' values, a tuple a row, in the order of rows."""
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"_k int, {schema}")
    return [tuple(r)[1:] for r in df.select("_k", *columns).orderBy("_k").collect()]


def test_links_and_names(spark):
    got = values(spark, [("f/1", "a b"), ("f", None), (None, "x")], "f string, p string", M.folder_link(F.col("f"), F.col("p")))
    assert got == [("googledrivefolder=f%2F1&photo=a+b",), ("googledrivefolder=f",), (None,)]
    urls = ["http://v/a%2Fb?x=1%2F2%2f3#c%2Fd", "http://v/a%2Fb", "?a%2Fb", "http://v/#q?x%2Fy", None]
    assert [r[0] for r in values(spark, [(u,) for u in urls], "u string", M.plain_slashes(F.col("u")))] == ["http://v/a%2Fb?x=1/2/3#c%2Fd", "http://v/a%2Fb", "?a/b", "http://v/#q?x%2Fy", None]
    assert values(spark, [(["a", "b"],), ([],), (None,)], "i array<string>", C.files_token(F.col("i"))) == [("a/b",), ("",), (None,)]
    assert values(spark, [("three_d_Cross",), ("two_d",), (None,)], "k string", M.is_stereo_type(F.col("k")), M.by_name(F.col("k"), ["two_d"]), M.in_states(F.col("k"), "two_d", "x")) == [(True, None, False), (False, "two_d", True), (None, None, None)]
    token = C.album_token(F.col("u"), F.col("i"), F.col("a"), F.col("k"))
    tokens = [("12", "7", "Trip", "K"), ("12", None, "Trip", None), ("12", "7", None, None), (None, "7", "x", None), ("12", None, None, "K")]
    parsed = [("12/7/Trip/K", ("12", "7", "Trip", "K")), ("12//Trip", ("12", None, "Trip", None)), ("12/7", ("12", "7", None, None)), ("/7/x", None), ("12///K", None)]
    assert [(r[0], r[1] and tuple(r[1])) for r in values(spark, tokens, "u string, i string, a string, k string", token, C.parse_album_token(token))] == parsed
    assert values(spark, [(404, "gone"), (None, None)], "code int, message string", M.error_text(F.struct("code", "message"))) == [('{"code":404,"message":"gone"}',), ("{}",)]


def test_texts_and_bytes(spark):
    texts = ["", "aé", "\U0001f600!", None]
    got = values(spark, [(t,) for t in texts], "t string", M.codes(F.col("t")), M.from_codes(M.codes(F.col("t"))))
    assert [r[0] for r in got] == [[], [97, 233], [0xD83D, 0xDE00, 33], None] and [r[1] for r in got] == texts
    data = [b"", b"\x00", b"\x0a\xff\x01", bytes(range(20))]
    got = values(spark, [(d,) for d in data], "d binary", M.hex_dump(F.col("d")), M.reversed_bytes(F.col("d")), C.signed32(F.col("d"), 0), C.signed32(F.col("d"), F.lit(16), True))
    assert [r[0] for r in got] == [" ".join(f"{x:x}" for x in d) for d in data] and [bytes(r[1]) for r in got] == [d[::-1] for d in data]
    assert [r[2:] for r in got] == [(None, None)] * 3 + [(0x00010203, 0x13121110)]
    assert values(spark, [(b"\xff\xff\xff\xfe",)], "d binary", C.signed32(F.col("d"), 0), C.signed32(F.col("d"), 0, True)) == [(-2, -16777217)]
    lines = ["", "a" * 73, "b" * 74, "é\n" * 200, None]
    got = [r[0] for r in values(spark, [(t,) for t in lines], "t string", M.lines_of(F.col("t")))]
    assert got == [t if t is None else [t[:73], *(t[k : k + 78] for k in range(73, len(t), 78))] for t in lines]
    urls = ["data:image/png;base64,YQ==", "data:;base64,YQ==", "data:image;base64,YQ==", "data:image/png,YQ==", "data:image/png;base64", "http://x", None]
    assert [r[0] for r in values(spark, [(u,) for u in urls], "u string", C.data_url_mime(F.col("u")))] == ["image/png", "", None, None, None, None, None]


def test_layouts(spark):
    assert values(spark, [(80,), (81,)], "h int", M.thumb_width(F.col("h"))) == [(120,), (122,)]
    place = lambda right: M.cross_layout(F.lit(1000), F.lit(600), F.lit(48), F.lit(400), F.lit(300), F.lit(right))
    left, right = values(spark, [(1,)], "x int", place(False), place(True))[0]
    assert (left.width, left.height) == (right.width, right.height) == (350, 263) and left.x + left.width + M.GAP == right.x == 502 and left.y == right.y == 168


def test_small_operators(spark):
    messages = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "kind string, n int")
    got = A.dispatch(messages, "kind", {"a": lambda d: d.select((F.col("n") * 10).alias("m")), "b": lambda d: d.select((-F.col("n")).alias("m"))})
    assert sorted(r[0] for r in got.collect()) == [-2, 10] and A.dispatch(messages, "kind", {}).count() == 0
    assert values(spark, [(None, "y"), ("x", "y"), (None, None)], "a string, b string", A.first_accepted(F.col("a"), F.col("b"))) == [("y",), ("x",), (None,)]
    canvas = spark.createDataFrame([(x, y) for x in range(2) for y in range(2)], "x int, y int")
    drawn = spark.createDataFrame([(1, 0, 5, 6, 7, 8)], "x int, y int, r int, g int, b int, a int")
    assert {tuple(r) for r in A.on_white(drawn, canvas, ["x", "y"]).collect()} == {(0, 0, *[255] * 4), (0, 1, *[255] * 4), (1, 1, *[255] * 4), (1, 0, 5, 6, 7, 8)}
    pixels = spark.createDataFrame([(1, x, y, 10 * x + y) for x in range(3) for y in range(2)], "p int, x int, y int, v int")
    wanted = spark.createDataFrame([(1, x, y) for x in (0, 2, 5) for y in (1, 4)], "p int, x int, y int")
    sizes = spark.createDataFrame([(1, 3, 2)], "p int, width int, height int")
    assert {(r.x, r.y): r.v for r in B.padded(wanted, pixels, sizes, ["p"]).collect()} == {(0, 1): 1, (0, 4): 1, (2, 1): 21, (2, 4): 21, (5, 1): 21, (5, 4): 21}
    have = spark.createDataFrame([("x", 5)], "source string, album long")
    asked = spark.createDataFrame([("z",), ("x",), ("y",), ("z",), (None,)], "source string")
    assert {tuple(r) for r in A.source_albums(have, asked, "source", "album").collect()} == {("x", 5), ("y", 6), ("z", 7)}
    assert {tuple(r) for r in A.source_albums(have.where("false"), asked, "source", "album").collect()} == {("x", 1), ("y", 2), ("z", 3)}


def test_clusters_over_batches(spark):
    """Groups with null keys, values below 0 and null, over Arrow batches of few rows, against a walk through the rows."""
    draw = random.Random(2)
    rows = [(draw.choice([None, "a", "b"]), draw.choice([None, 1]), k, draw.choice([None, 0, 3, 7, 11, 40] if k % 2 else [5, -4])) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, h int, k int, v long").repartition(3)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.k: (r.cluster, r.time) for r in R.clusters(df, ["g", "h"], ["k"], F.col("v"), 30).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    state, want = {}, {}
    for g, h, k, v in rows:
        cluster, total = state.get((g, h), (0, 0))
        want[k] = cluster, total
        total += v or 0
        state[g, h] = (cluster + 1, 0) if total >= 30 else (cluster, total)
    assert got == want and max(c for c, _ in want.values()) > 5


def test_transforms_and_back(spark):
    draw = random.Random(1)
    rows = [([draw.randrange(-255, 256) for _ in range(16)],) for _ in range(60)] + [([0] * 16,), ([255] * 16,), ([-255] * 16,)]
    d = F.col("d")
    got = values(spark, rows, "d array<long>", d, B.inverse_transform(B.forward_transform(d)), B.inverse_mean_transform(B.mean_transform(d)))
    assert all(abs(a - b) <= 1 for x, y, _ in got for a, b in zip(x, y, strict=True))
    assert all(abs(a - b) <= 1 for x, _, y in got for a, b in zip(x, y, strict=True))
    m = B.matrix(F.lit(4), F.lit(4), "luma")
    lost = values(spark, rows, "d array<long>", B.distortion(d, B.inverse_transform(B.restored(B.quantised(B.forward_transform(d), m), m))))
    assert all(0 <= r[0] <= 16 * 25 for r in lost)
    assert values(spark, [(30,), (64,), (100,), (255,), (0,)], "c int", *B.chroma_offsets(F.col("c"), F.lit(50))) == [(-2, -2), (-2, 0), (-2, 2), (-2, 6), (-2, -4)]


def test_side_by_side_shares(spark):
    """Shares of a source pixel and of a target pixel add up, at sizes that do not divide each other; a white picture stays white."""
    sizes = [(w, t) for w in (1, 2, 5, 7, 12) for t in range(1, w + 1)]
    rows = [(x, w, t) for w, t in sizes for x in range(w)]
    got = values(spark, rows, "x int, w int, t int", "x", "w", "t", P._shares(F.col("x"), F.col("w"), F.col("t")))
    for w, t in sizes:
        mine = [s for _, a, b, shares in got if (a, b) == (w, t) for s in shares]
        assert sum(s.share for s in mine) == w * t and all(sum(s.share for s in mine if s.to == k) == w for k in range(t))
    pictures = spark.createDataFrame([(1, 7, 5, 2), (2, 7, 5, -2), (3, 4, 3, 4), (4, 40, 8, 0)], "p int, width int, height int, parallax int")
    pixels = spark.createDataFrame([(p, e, x, y, 255 if p != 2 else x) for p, w, h, _ in pictures.collect() for e in range(2) for x in range(w) for y in range(h)], "p int, eye int, x int, y int, v int")
    canvas = P.side_by_side(pixels, pictures, "p", ["v"], max_width=10, max_height=4).collect()
    count = {k: len([r for r in canvas if r.p == k]) for k in (1, 2, 3, 4)}
    assert count == {1: 2 * 4 * 4, 2: 2 * 4 * 4, 3: 0, 4: 2 * 10 * 2} and {r.v for r in canvas if r.p in (1, 4)} == {255}
    eyes = [[r.v for r in sorted(canvas, key=lambda r: r.x) if r.p == 2 and r.y == 0 and (r.x >= 4) == right] for right in (False, True)]
    assert [b - a for a, b in zip(*eyes, strict=True)] == [2, 2, 2, 2]  # the right one's left edge is cut


def test_videos_from_a_stream(spark, tmp_path):
    """Videos are written in the batch in which their last frame comes; a batch that comes again changes nothing."""

    def webp(n):
        body = b"WEBPVP8 " + struct.pack("<I", n) + b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 4, 4) + bytes([n]) * n
        return b"RIFF" + struct.pack("<I", len(body)) + body

    frame = lambda doc, k, last=False, ms=40: (doc, k, ms, 4, 4, False, webp(k + 1), last)
    batches = [[frame("a", 0), frame("b", 0)], [frame("a", 1), frame("b", 1, True), frame("c", 0, ms=0)], [frame("a", 2, True), frame("c", 1, True)], [frame("d", 0)]]
    for k, some in enumerate(batches):
        spark.createDataFrame(some, videos.FRAMES).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        aside, folder = f"file://{tmp_path}/aside", f"file://{tmp_path}/out"
        if k < 3:
            videos.take_batch(spark.read.schema(videos.FRAMES).parquet(f"{tmp_path}/in/{k}"), k, aside, folder)
            done = {p.name for p in (tmp_path / "out").glob("batch*/*")} if (tmp_path / "out").exists() else set()
            assert done == [set(), {"b.webm"}, {"a.webm", "b.webm"}][k]
    before = {p: p.read_bytes() for p in (tmp_path / "out").glob("batch*/*")}
    videos.take_batch(spark.read.schema(videos.FRAMES).parquet(f"{tmp_path}/in/1"), 1, aside, folder)
    assert {p: p.read_bytes() for p in (tmp_path / "out").glob("batch*/*")} == before
    assert {tuple(r) for r in videos.errors(spark, aside).collect()} == {("c", "a frame without duration", 2)}
    whole = next(v for p, v in before.items() if p.name == "a.webm")
    assert all(bytes([k + 1]) * (k + 1) in whole for k in range(3)) and whole.startswith(bytes.fromhex("1a45dfa3"))
    stream = spark.readStream.schema(videos.FRAMES).parquet(f"{tmp_path}/in/*")
    query = videos.build(stream, f"file://{tmp_path}/aside2", f"file://{tmp_path}/out2", f"{tmp_path}/c")
    query.awaitTermination(240)
    assert query.exception() is None
    assert {p.name: p.read_bytes() for p in (tmp_path / "out2").glob("batch*/*")} == {p.name: v for p, v in before.items()}
