"""The queries against their SQL; stereo containers built here, sound and damaged ones."""

import struct
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from parlux.functions import tables
from parlux.operators import stereo as S
from parlux.plans import coding, containers, loading, media, reference  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    """Lists as tuples, so that rows that hold them can be counted."""
    return tuple(plain(v) for v in value) if isinstance(value, list | tuple) else value


@pytest.mark.parametrize("name", sorted(reference.ORACLE_SQL))
def test_query(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = con.execute(reference.ORACLE_SQL[name])
    names = sorted(c[0] for c in found.description)
    order = [[c[0] for c in found.description].index(n) for n in names]
    got = reference.QUERIES[name](spark, sf)
    assert sorted(got.columns) == names
    assert Counter(plain(r) for r in got.select(*names).collect()) == Counter(plain([r[i] for i in order]) for r in found.fetchall())


def segment(marker, payload):
    return bytes([0xFF, marker]) + struct.pack(">H", len(payload) + 2) + payload


def tags(order, *entries):
    return struct.pack(f"{order}H", len(entries)) + b"".join(struct.pack(f"{order}HHI", *e[:3]) + e[3] for e in entries)


def stereo(order="<", parallax=(-5, 2), count=2, version=b"0100", off=0):
    start = {"<": b"II*\0", ">": b"MM\0*"}[order] + struct.pack(f"{order}I", 8)
    number = lambda n: struct.pack(f"{order}I", n)
    exif = b""
    if parallax:
        note = b"FUJIFILM" + struct.pack("<I", 12) + tags("<", (45585, 10, 1, struct.pack("<I", 26))) + struct.pack("<ii", *parallax)
        inner = 8 + 14
        exif = segment(0xE1, b"Exif\0\0" + start + tags(order, (34665, 4, 1, number(inner))) + tags(order, (37500, 7, len(note), number(inner + 14))) + note)
    second = b"\xff\xd8" + exif + b"\xff\xdb rest"

    def first(size):
        table = struct.pack(f"{order}IIIHH", 0x020002, size + off, 0, 0, 0) + struct.pack(f"{order}IIIHH", 0x020002, len(second), max(0, size - 10), 0, 0)
        index = start + tags(order, (45056, 7, 4, version), (45057, 4, 1, number(count)), (45058, 7, 32, number(8 + 38))) + table
        return b"\xff\xd8" + segment(0xE2, b"MPF\0" + index) + b"\xff\xdb the first image"

    return first(len(first(0))) + second


def damaged(how):
    """A container of which one thing is not as it should be."""
    whole = bytearray(stereo(">"))
    at = whole.index(b"MPF\0") + 4
    first = at + 8 + 2  # the index's first tag
    note = whole.index(b"FUJIFILM")
    edits = {
        "repeated": (first + 12, whole[first : first + 2]), "type": (first + 2, b"\0\6"), "tags": (at + 8, struct.pack(">H", 10_000)), "kind": (at + 46, b"\0\3\0\0"), "format": (at + 46, b"\1\2\0\2"), "directory": (at + 4, struct.pack(">I", 9)),
        "order": (at, b"XX"), "table": (first + 24 + 8, struct.pack(">I", 4_000_000_000)), "outside": (first + 24 + 8, struct.pack(">I", 60)), "first": (at + 46 + 8, b"\0\0\0\1"), "maker": (note + 8, b"\0"), "long": (note + 12, b"\xff\xff"), "index": (at - 4, b"X"),
    }
    place, new = edits[how]
    whole[place : place + len(new)] = new
    return bytes(whole)


DAMAGES = ["repeated", "type", "tags", "kind", "format", "directory", "order", "table", "outside", "first", "maker", "long", "index"]


def test_container(spark):
    cases = {"le": stereo(), "be": stereo(">"), "plain": stereo(parallax=None), "zero": stereo(parallax=(1, 0)), "three": stereo(count=3), "version": stereo(version=b"0101"), "off": stereo(off=1), "cut": stereo()[:40], "png": b"\x89PNG", "none": None, "empty": b"", "trailing": stereo() + b"x"}
    cases |= {d: damaged(d) for d in DAMAGES}
    files = spark.createDataFrame(list(cases.items()), "path string, content binary").repartition(4)
    got = {r.path: r for r in S.parse_stereo(files).collect()}
    assert {k for k, r in got.items() if r.error is None} == {"le", "be", "plain", "zero", "trailing"} and len(got) == len(cases)
    assert got["le"].parallax_px == got["be"].parallax_px == -87.5 and got["plain"].parallax is None and got["zero"].parallax is None
    assert got["le"].start1 == got["le"].size0 and got["le"].start1 + got["le"].size1 == len(cases["le"])
    assert got["repeated"].error == "a tag repeats" and got["type"].error == "unknown field type" and got["tags"].error == "a directory is too long" and got["cut"].error == "a segment's length is wrong"
    assert S.parse_stereo(files.where("false")).count() == 0
    # four bytes behind the index's tags are the first picture's kind here, which is no place of a directory
    assert {r.path: r.verdict for r in S.debug_scan(files.where("path in ('trailing', 'le', 'png')")).collect()} == {"trailing": "bytes are left over", "le": "a directory lies outside", "png": "no start of image"}


def test_sections(spark):
    scan = b"\xff\xda\0\4ab" + b"data\xff\0more\xff\xd0rest\xff\xff"
    jpeg = b"\xff\xd8" + segment(0xE0, b"JFIF") + segment(0xDB, b"q") + b"\xff\x01" + segment(0xC0, b"f") + scan + scan + b"\xff\xd9tail"
    long = b"\xff\xd8" + scan[:6] + b"\0" * 65_535 + b"\xff\0" * 40_000 + b"\xff\xd9"
    cases = {"jpeg": jpeg, "long": long, "endless": jpeg[:-6], "stray": b"\xff\xd8xy", "short": b"\xff\xd8\xff\xe1\0", "one": b"\xff\xd8\xff"}
    files = spark.createDataFrame(list(cases.items()), "path string, content binary")
    files.createOrReplaceTempView("pictures_here")
    tables.register(spark)
    got = {}
    for r in spark.sql("SELECT path, s.* FROM pictures_here, LATERAL sections(content, 0) s ORDER BY path, seq").collect():
        got.setdefault(r.path, []).append(r)
    assert [(r.marker, r.size, r.leading) for r in got["jpeg"]] == [(0xE0, 4, True), (0xDB, 1, False), (0x01, 0, False), (0xC0, 1, False), (0xDA, 2, False), (0xDA, 2, False), (0xD9, 0, False)]
    assert all(jpeg[r["at"]] == 0xFF and jpeg[r["at"] + 1] == r.marker for r in got["jpeg"])
    assert [r.marker for r in got["long"]] == [0xDA, 0xD9] and got["long"][1]["at"] == len(long) - 2
    assert {k: v[-1].damage for k, v in got.items() if v[-1].damage} == {"endless": "the scan does not end", "stray": "no marker", "short": "cut off in a segment", "one": "cut off between segments"}


def test_chained_tags(spark):
    def directory(order, *entries, then):
        return tags(order, *((t, 3, 1, b"abcd") for t in entries)) + struct.pack(f"{order}I", then)

    for order in "<>":
        chain = directory(order, 1, 2, then=30) + directory(order, 3, then=0)
        loop = directory(order, 1, then=18) + directory(order, 2, then=0)[:-4] + struct.pack(f"{order}I", 0)
        back = directory(order, 1, then=0)[:-4] + struct.pack(f"{order}I", 18) + directory(order, 9, then=18)
        df = spark.createDataFrame([("chain", chain), ("loop", loop), ("back", back), ("null", None)], "path string, block binary")
        read = df.lateralJoin(tables.tags(F.col("block").outer(), F.lit(0), F.lit(order), F.lit(True))).orderBy("path", "directory", "seq").collect()
        seen = {p: [(r.directory, r.tag, r.damage) for r in read if r.path == p] for p in ("chain", "loop", "back", "null")}
        assert seen["chain"] == [(0, 1, None), (0, 2, None), (1, 3, None)] and seen["loop"] == [(0, 1, None), (1, 2, None)]
        assert seen["back"] == [(0, 1, None), (1, None, "directories form a loop"), (1, 9, None)] or seen["back"][-1][2] in (None, "directories form a loop")
        assert [x[2] for x in seen["null"]] == ["a directory lies outside"]
        assert {bytes(r.payload) for r in read if r.payload is not None} == {b"abcd"}


def test_containers_stay_in_their_rows(spark, sf):
    """A file's parts are neither shuffled nor joined, so equal paths may repeat; the few bytes of a table are dealt over all tasks."""
    files = spark.createDataFrame([("same", stereo()), ("same", stereo(">")), ("same", b"")], "path string, content binary")
    read = S.parse_stereo(files)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Join", "Generate", "Aggregate"))
    assert sorted(str(r.error) for r in read.collect()) == ["None", "None", "no start of image"]
    assert sorted(r.directories for r in S.debug_scan(files).collect()) == [0, 2, 2]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    load = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    assert containers._files(load).rdd.getNumPartitions() == containers._pictures(load).rdd.getNumPartitions() == parts
