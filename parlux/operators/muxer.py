"""Element trees of a container as tables, and videos of key frames in it.

A tree is a table of nodes: doc, path (array<int>: the places of a node among its siblings, from the root down; sorted, paths are in
document order), id (of the element), payload (binary; null for a node with children) and, for a position, target and origin (paths):
its payload is the 4-byte distance between these two nodes. Lengths are summed from a document's end, places are a running sum in its
order, positions are joined from places: all are tables of numbers, payloads travel once, to the file that they make up
(sources/written.py writes it part by part).

Nodes of a document need distinct paths and a parent each, but the roots; other nodes have no defined place. A document with an element that
has neither payload nor children, or a position that can't be told, is an error, not a file. Empty tables give no rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlux.functions import columns as C
from parlux.operators import relational as R
from parlux.operators.shared import kept, small_or_shuffled

#: Element ids.
HEADER, SEGMENT, SEEK_HEAD, SEEK, SEEK_ID, SEEK_POSITION = 0x1A45DFA3, 0x18538067, 0x114D9B74, 0x4DBB, 0x53AB, 0x53AC
INFO, TIME_SCALE, MUXING_APP, WRITING_APP, DURATION = 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741, 0x4489
TRACKS, TRACK, VIDEO, CLUSTER, CLUSTER_TIME, BLOCK = 0x1654AE6B, 0xAE, 0xE0, 0x1F43B675, 0xE7, 0xA3
CUES, CUE, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: The header's fields, and a track's (number, id, lacing, language, codec, its name, type), in order.
HEADER_FIELDS = [(0x4286, 1), (0x42F7, 1), (0x42F2, 4), (0x42F3, 8), (0x4282, "webm"), (0x4287, 2), (0x4285, 2)]
TRACK_FIELDS = [(0xD7, 1), (0x73C5, 1), (0x9C, 0), (0x22B59C, "und"), (0x86, "V_VP8"), (0x258688, "VP8"), (0x83, 1)]
WIDTH, HEIGHT, STEREO = 0xB0, 0xBA, 0x53B8
#: Milliseconds after which a cluster is closed, bytes of a position, nanoseconds of a time unit.
CLUSTER_MS, REFERENCE, SCALE = 30_000, 4, 1_000_000
#: Fixed value: milliseconds of a frame for which nobody says how long it is.
FRAME_MS = 1000


def number(value: Column | int) -> Column:
    """An unsigned number as the fewest bytes."""
    if isinstance(value, int):
        return F.lit(value.to_bytes(max(1, -(-value.bit_length() // 8)), "big"))
    return C.let(value.cast("long"), lambda v: F.unhex(C.ebml_number(v)))


def double(value: Column) -> Column:
    """The eight big-endian bytes of a double that is zero or a normal number."""
    exact = lambda x, g: g - F.when(F.pow(F.lit(2.0), g) > x, 1).otherwise(0) + F.when(F.pow(F.lit(2.0), g + 1) <= x, 1).otherwise(0)
    bits = lambda x, p: (p + 1023).cast("long") * (1 << 52) + ((x / F.pow(F.lit(2.0), p) - 1) * float(1 << 52)).cast("long")
    number = lambda x: F.when(x == 0, F.lit(0).cast("long")).otherwise(C.let(F.floor(F.log2(x)).cast("int"), lambda g: C.let(exact(x, g), lambda p: bits(x, p))))
    sign = F.when(value < 0, F.lit(-(1 << 63))).otherwise(F.lit(0).cast("long"))
    return F.unhex(F.lpad(F.hex(C.let(F.abs(value.cast("double")), number).bitwiseOR(sign)), 16, "0"))


def bit_string(bits: Column) -> Column:
    """A text of 0 and 1 as bytes, zero-padded in front to whole ones."""
    padded = F.lpad(bits, (F.ceil(F.length(bits) / 8) * 8).cast("int"), F.lit("0"))
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), (F.length(padded) / 8 - 1).cast("int")), lambda k: F.lpad(F.conv(F.substr(padded, k * 8 + 1, F.lit(8)), 2, 16), 2, "0")), ""))


def _header(size: Column) -> Column:
    return F.unhex(F.concat(C.let(F.col("id"), C.ebml_id), C.let(size, C.ebml_size)))


def _sized(lean: DataFrame) -> DataFrame:
    """lean (doc, path, leaf, size of a leaf) with every node's size and head, level by level from the deepest one: a level's sizes are sums of
    the level below by parent, which combine before their shuffle, so that neither a large document nor a node of many children gathers
    anywhere. Levels are few, as a container's kinds of elements are. Sizes of nodes that have no content are null."""
    deepest = lean.agg(F.max(F.size("path"))).first()[0] or 0
    levels: list[DataFrame] = []
    for level in range(deepest, 0, -1):
        mine = lean.where(F.size("path") == level)
        if levels:
            sums = levels[-1].groupBy("doc", F.slice("path", 1, level).alias("path")).agg(F.sum(F.col("size") + F.col("head")).alias("_inside"))
            mine = mine.join(sums, ["doc", "path"], "left").withColumn("size", F.when(F.col("leaf"), F.col("size")).otherwise(F.col("_inside"))).drop("_inside")
        head = F.octet_length(F.unhex(C.ebml_id(F.col("id")))) + C.ebml_width(F.col("size"))
        levels.append(kept(mine.withColumn("head", head.cast("long"))))
    if not levels:
        return lean.withColumn("head", F.lit(0).cast("long"))
    return reduce(DataFrame.unionByName, levels)


def laid_out(nodes: DataFrame) -> DataFrame:
    """nodes with size (of the payload), head (bytes before it), place (of the node's first byte), payload with positions filled in, and error:
    what keeps an element from being written (null for a sound one). Places behind an element with an error have no meaning. The table
    of numbers is kept in the shared folder, as it is used three times; payloads are not in it."""
    reference = F.col("target").isNotNull()
    own = F.when(reference, REFERENCE).otherwise(F.octet_length("payload")).cast("long")
    lean = kept(nodes.select("doc", "path", "id", "target", "origin", (reference | F.col("payload").isNotNull()).alias("leaf"), own.alias("size")))
    bytes_here = F.coalesce(F.col("head") + F.when(F.col("leaf"), F.col("size")).otherwise(0), F.lit(0))
    placed = kept(R.sum_before(_sized(lean), "doc", "path", bytes_here, "place"))
    spot = lambda name: placed.select("doc", F.col("path").alias(name), F.col("place").alias(f"_{name}"))
    found = placed.where("target is not null").join(spot("target"), ["doc", "target"]).join(spot("origin"), ["doc", "origin"])
    values = found.select("doc", "path", F.unhex(C.ebml_number(F.col("_target") - F.col("_origin"), REFERENCE)).alias("value"))
    numbers = placed.select("doc", "path", "size", "head", "place").join(values, ["doc", "path"], "left")
    rows = nodes.join(numbers, ["doc", "path"])
    error = F.when(F.col("size").isNull() | F.col("head").isNull(), "an element has no content").when(reference & F.col("value").isNull(), "a position can't be told")
    return rows.withColumn("error", error).withColumn("payload", F.coalesce("value", "payload")).drop("value")


def file_parts(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, path, part: the bytes of each node without its children, for written.write_parts; doc, error of the documents that can't be
    written, of which there are no parts)."""
    rows = laid_out(nodes)
    errors = kept(rows.where("error is not null").groupBy("doc").agg(F.min("error").alias("error")))
    part = F.concat(_header(F.col("size")), F.coalesce("payload", F.lit(b"")))
    return rows.join(small_or_shuffled(errors.select("doc")), "doc", "left_anti").select("doc", "path", part.alias("part")), errors


def _path(*places: Column | int) -> Column:
    return F.array(*(F.lit(p) if isinstance(p, int) else p.cast("int") for p in places)).cast("array<int>")


def _rows(df: DataFrame, *nodes: tuple[Column, int | Column, Column | None] | tuple[Column, int | Column, None, Column, Column]) -> DataFrame:
    """A row for each node of each row of df: (path, id, payload[, target, origin])."""
    none = F.lit(None).cast("array<int>")
    made = [F.struct(n[0].alias("path"), (F.lit(n[1]) if isinstance(n[1], int) else n[1]).cast("long").alias("id"), (F.lit(None).cast("binary") if n[2] is None else n[2]).alias("payload"), (n[3] if len(n) > 3 else none).alias("target"), (n[4] if len(n) > 3 else none).alias("origin")) for n in nodes]
    return df.select("doc", F.inline(F.array(*made)))


def checked_frames(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frames (doc, idx, duration, width, height, stereo, webp) of which videos can be made, and what is wrong with the others.

    (videos: doc, width, height, stereo; frames: doc, idx, cluster, time, duration, data; errors: doc, error) as (videos with error, frames
    of sound ones). All frames of a video are to have one size, one kind of stereo and a positive duration (null: FRAME_MS), and to be
    key frames of that size; the first frame says what the video is."""
    rows = frames.withColumns({"duration": F.coalesce("duration", F.lit(FRAME_MS)).cast("long"), "data": vp8_frame(F.col("webp"), F.col("width"), F.col("height"))})
    first = F.min_by(F.struct("width", "height", "stereo"), "idx")
    differs = lambda c: F.coalesce(F.min(c) != F.max(c), F.lit(True)) | (F.count(c) < F.count("*"))
    error = F.when(differs("width"), "frames of several widths").when(differs("height"), "frames of several heights").when(differs("stereo"), "stereo frames among others").when(F.min("duration") <= 0, "a frame without duration").when(F.count("data") < F.count("*"), "a frame is no key frame of its size")
    videos = kept(rows.groupBy("doc").agg(first.alias("v"), error.alias("error")).select("doc", "v.*", "error"))
    sound = rows.join(small_or_shuffled(videos.where("error is null").select("doc")), "doc", "left_semi")
    timed = R.clusters(sound, ["doc"], ["idx"], F.col("duration"), CLUSTER_MS)
    return videos, timed.join(sound.select("doc", "idx", "duration", "data"), ["doc", "idx"])


def video_nodes(videos: DataFrame, frames: DataFrame, app: str = "parlux") -> DataFrame:
    """The tree of each video.

    videos: doc, width, height, stereo (side by side: the track is half as wide); frames: doc, idx, cluster, time (milliseconds in its
    cluster), duration, data. Every frame is a key frame with a cue; a cluster's own time is 0."""
    text = lambda s: F.lit(s.encode())
    field = lambda v: number(v) if isinstance(v, int) else text(v)
    info = videos.join(frames.groupBy("doc").agg(F.sum("duration").alias("ms"), (F.max("cluster") + 1).alias("clusters")), "doc")
    seek = lambda k, name, target: [(_path(2, 1, k), SEEK, None), (_path(2, 1, k, 1), SEEK_ID, number(name)), (_path(2, 1, k, 2), SEEK_POSITION, None, target, _path(2, 1))]
    cues = F.col("clusters") + 4  # children of the segment: seek head, info, tracks, clusters, cues
    whole = _rows(
        info, (_path(1), HEADER, None), *((_path(1, k), i, field(v)) for k, (i, v) in enumerate(HEADER_FIELDS, 1)), (_path(2), SEGMENT, None), (_path(2, 1), SEEK_HEAD, None),
        *seek(F.lit(1), INFO, _path(2, 2)), *seek(F.lit(2), TRACKS, _path(2, 3)), *seek(F.col("clusters") + 3, CUES, _path(2, cues)),
        (_path(2, 2), INFO, None), (_path(2, 2, 1), TIME_SCALE, number(SCALE)), (_path(2, 2, 2), MUXING_APP, text(app)), (_path(2, 2, 3), WRITING_APP, text(app)), (_path(2, 2, 4), DURATION, double(F.col("ms"))),
        (_path(2, 3), TRACKS, None), (_path(2, 3, 1), TRACK, None), *((_path(2, 3, 1, k), i, field(v)) for k, (i, v) in enumerate(TRACK_FIELDS, 1)), (_path(2, 3, 1, 8), VIDEO, None),
        (_path(2, 3, 1, 8, 1), WIDTH, number(F.when(F.col("stereo"), F.floor(F.col("width") / 2)).otherwise(F.col("width")))), (_path(2, 3, 1, 8, 2), HEIGHT, number(F.col("height"))), (_path(2, cues), CUES, None),
    )
    stereo = _rows(info.where("stereo"), (_path(2, 3, 1, 8, 3), STEREO, number(1)))
    at = F.col("cluster") + 4
    clusters = _rows(frames.select("doc", "cluster").distinct(), (_path(2, at), CLUSTER, None), (_path(2, at, 0), CLUSTER_TIME, number(0)), *seek(F.col("cluster") + 3, CLUSTER, _path(2, at)))
    # a block: track 1, its time as two bytes, flags of a key frame, the data
    block = F.concat(F.lit(b"\x81"), F.unhex(F.lpad(F.hex(F.col("time").bitwiseAND(F.lit(0xFFFF))), 4, "0")), F.lit(b"\x80"), "data")
    rows = frames.join(info.select("doc", "clusters"), "doc")
    k = F.col("idx") + 1
    blocks = _rows(rows, (_path(2, at, k), BLOCK, block), (_path(2, cues, k), CUE, None), (_path(2, cues, k, 1), CUE_TIME, number(F.col("time"))), (_path(2, cues, k, 2), CUE_POSITIONS, None), (_path(2, cues, k, 2, 1), CUE_TRACK, number(1)), (_path(2, cues, k, 2, 2), CUE_CLUSTER, None, _path(2, at), _path(2, 1)))
    return whole.unionByName(stereo).unionByName(clusters).unionByName(blocks)


def vp8_frame(webp: Column, width: Column, height: Column) -> Column:
    """The frame data of a WebP file with one key frame, or null where it isn't one of that size: tags, length, marker and scale must fit."""
    text = lambda at, n: F.substr(webp, F.lit(at + 1), F.lit(n))
    size = lambda at: C.unsigned(webp, at, 2, True)
    fine = (text(0, 4) == F.lit(b"RIFF")) & (C.unsigned(webp, 4, 4, True) == F.octet_length(webp) - 8) & (text(8, 8) == F.lit(b"WEBPVP8 ")) & (text(23, 3) == F.lit(b"\x9d\x01\x2a"))
    return F.when(fine & (size(26) == width) & (size(28) == height) & (width < 1 << 14) & (height < 1 << 14), F.substr(webp, F.lit(21)))
