"""Table functions over bytes, for lateral joins: the marker sections of a picture, the tags of directories.

In Python: files.lateralJoin(sections(F.col("content").outer(), F.lit(0))). In SQL, after register(spark):
SELECT path, s.* FROM files, LATERAL sections(content, 0) s. Bytes travel in Arrow batches.

What is damaged gives a row that says so in damage, as the last one; rows before it are what could be read. Null bytes are empty.

A table function makes an Arrow batch of each row that it is called for. For tables of many rows there are walked, leading and chained:
the same rows as an array in a column, by whole batches, with nothing to join. Spark takes them as not deterministic, so that it doesn't
copy them into filters."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql.functions import arrow_udf, udtf

#: Start and end of a picture, start of a scan, markers without a length, application segments, field types.
START, END, SCAN, ALONE = b"\xff\xd8", 0xD9, 0xDA, {0x01, *range(0xD0, 0xD8)}
FIRST_APP, LAST_APP = 0xE0, 0xEF
TYPES = (1, 2, 3, 4, 5, 7, 9, 10)
#: Most tags of a directory, segments whose payload is given: those with tags and with an index of pictures.
MAX_TAGS, BLOCKS = 9999, (b"Exif\0\0", b"MPF\0")
#: Bytes in which the end of a scan is looked for at a time.
WINDOW = 1 << 16
SECTIONS = "seq int, marker int, at long, start long, size long, leading boolean, block binary, damage string"
TAGS = "directory int, seq int, tag int, type int, count long, place long, value long, payload binary, damage string"


def scan_end(data: bytes, at: int) -> int:
    """The place of the first marker in a scan's data; 0xFF00 stands for a byte of data, restarts and fill bytes belong to the scan."""
    while at + 1 < len(data):
        window = np.frombuffer(data, np.uint8, min(WINDOW + 1, len(data) - at), at)
        behind = window[1:]
        found = np.flatnonzero((window[:-1] == 0xFF) & (behind != 0) & (behind != 0xFF) & ~((behind >= 0xD0) & (behind <= 0xD7)))
        if len(found):
            return at + int(found[0])
        at += WINDOW
    return -1


class Sections:
    """The sections of the picture that begins at a place: seq, marker, at (of the marker), start and size (of the payload), leading
    (none but application segments so far), block (the payload of segments in BLOCKS, behind their name).

    A scan's size is its header's; the data behind it belong to no section. The walk ends behind the picture's end marker."""

    def eval(self, content: bytes | None, at: int) -> Iterator[tuple]:
        data, seq, leading = content or b"", 0, True
        damaged = lambda what: (seq, None, at, None, None, leading, None, what)
        if at is None or at < 0 or data[at : at + 2] != START:
            yield damaged("no start of image")
            return
        at += 2
        while True:
            if at + 2 > len(data):
                yield damaged("cut off between segments")
                return
            marker = data[at + 1] if data[at] == 0xFF else None
            leading = leading and marker is not None and FIRST_APP <= marker <= LAST_APP
            if marker is None:
                yield damaged("no marker")
                return
            if marker == END or marker in ALONE:
                yield seq, marker, at, at + 2, 0, leading, None, None
                if marker == END:
                    return
                seq, at = seq + 1, at + 2
                continue
            if at + 4 > len(data):
                yield damaged("cut off in a segment")
                return
            size = struct.unpack_from(">H", data, at + 2)[0]
            if size < 2 or at + 2 + size > len(data):
                yield damaged("a segment's length is wrong")
                return
            name = next((b for b in BLOCKS if leading and data[at + 4 : at + 2 + size].startswith(b)), None)
            yield seq, marker, at, at + 4, size - 2, leading, None if name is None else data[at + 4 + len(name) : at + 2 + size], None
            seq, at = seq + 1, at + 2 + size
            if marker == SCAN:
                end = scan_end(data, at)
                if end < 0:
                    yield damaged("the scan does not end")
                    return
                at = end


class Tags:
    """The tags of the directory at a place of a block and, if chained, of those behind it (the four bytes behind a directory, if it has
    them, say where the next one is; 0 ends the chain): directory, seq, tag, type, count, place (of the payload's four bytes), value (they as
    an unsigned number) and payload (they as they are). order is > for the most significant byte first, else <."""

    def eval(self, block: bytes | None, at: int, order: str, chained: bool = False) -> Iterator[tuple]:
        data, seen, number = block or b"", set(), 0
        while True:
            damaged = lambda what: (number, None, None, None, None, None, None, None, what)  # noqa: B023, E731
            if at is None or order not in ("<", ">") or at < 0 or at + 2 > len(data):
                yield damaged("a directory lies outside")
                return
            if at in seen:
                yield damaged("directories form a loop")
                return
            seen.add(at)
            n = struct.unpack_from(f"{order}H", data, at)[0]
            if n > MAX_TAGS or at + 2 + 12 * n > len(data):
                yield damaged("a directory is too long")
                return
            tags = set()
            for k in range(n):
                place = at + 2 + 12 * k
                tag, kind, count, value = struct.unpack_from(f"{order}HHII", data, place)
                if kind not in TYPES or tag in tags:
                    yield damaged("a tag repeats" if kind in TYPES else "unknown field type")
                    return
                tags.add(tag)
                yield number, k, tag, kind, count, place + 8, value, data[place + 8 : place + 12], None
            end = at + 2 + 12 * n
            at = struct.unpack_from(f"{order}I", data, end)[0] if chained and end + 4 <= len(data) else 0
            if not at:
                return
            number += 1


def _kind(schema: str) -> str:
    return f"array<struct<{', '.join(f.replace(' ', ':') for f in schema.split(', '))}>>"


def _arrays(schema: str, found: Iterator[Iterator[tuple]]) -> pa.Array:
    """The rows of each value as an array of structs."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
    fields = [pa.field(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")]
    ends, rows = [0], []
    for some in found:
        rows += some
        ends.append(len(rows))
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    structs = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], fields=fields)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs)


def _walked(content: pa.Array) -> pa.Array:
    return _arrays(SECTIONS, (Sections().eval(c.as_py(), 0) for c in content))


def _leading(content: pa.Array) -> pa.Array:
    # behind a section that doesn't lead none does, so the walk ends there
    return _arrays(SECTIONS, (takewhile(lambda row: row[5], Sections().eval(c.as_py(), 0)) for c in content))


def _chained(block: pa.Array, order: pa.Array) -> pa.Array:
    return _arrays(TAGS, (() if b.as_py() is None or o.as_py() is None else Tags().eval(b.as_py(), 8, o.as_py(), True) for b, o in zip(block, order, strict=True)))


def walked(content: Column | str) -> Column:
    """All sections of a picture."""
    return arrow_udf(_walked, _kind(SECTIONS)).asNondeterministic()(content)


def leading(content: Column | str) -> Column:
    """The leading sections of a picture; nothing behind them is read."""
    return arrow_udf(_leading, _kind(SECTIONS)).asNondeterministic()(content)


def chained(block: Column | str, order: Column | str) -> Column:
    """Tags of the directory at a block's place 8 and of those chained to it; none of a null block or order."""
    return arrow_udf(_chained, _kind(TAGS)).asNondeterministic()(block, order)


sections = udtf(Sections, returnType=SECTIONS, useArrow=True)
tags = udtf(Tags, returnType=TAGS, useArrow=True)


def register(spark: SparkSession) -> None:
    """sections and tags for SQL."""
    spark.udtf.register("sections", sections)
    spark.udtf.register("tags", tags)
