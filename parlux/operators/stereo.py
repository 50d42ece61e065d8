"""Stereo containers by column expressions over sections of a file, tags of its directories, and what these must say.

A container is a picture with an index in one of its leading application segments; the index names two pictures, the first one and
another that begins where it ends. Contents go to Python workers by Arrow batches, once for the first picture's leading segments and, of
sound indexes only, once for the second picture; directories are read by Spark. All that belongs to a file stays in its row: nothing is
shuffled, joined or kept, whatever the number of files. A row with an error is what doesn't fit; nothing is dropped. Null content is an error
like any other that is no picture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlux.functions import columns as C
from parlux.functions import tables as T
from parlux.functions.columns import let

#: Byte orders, directory tags, kinds of fields and lengths of the file format.
BIG, LITTLE = b"MM\0*", b"II*\0"
EXIF_TAG, MAKER_TAG, PARALLAX_TAG, VERSION_TAG, COUNT_TAG, ENTRIES_TAG = 34665, 37500, 45585, 45056, 45057, 45058
LONG, UNDEFINED, SRATIONAL, TAGGED, INDEXED = 4, 7, 10, 0xE1, 0xE2
VERSION, MAKER, PICTURE_KIND, ENTRY, PIXELS = b"0100", b"FUJIFILM", 0x020002, 16, 35


def _first(*faults: tuple[Column, str]) -> Column:
    """The message of the first condition that holds or is unknown; null if there is none."""
    return F.coalesce(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(what)) for bad, what in faults))


def _order(block: Column) -> Column:
    """< or >, from what a block begins with; null for something else."""
    head = F.substr(block, F.lit(1), F.lit(4))
    return F.when(head == F.lit(LITTLE), "<").when(head == F.lit(BIG), ">")


def _place(value: Column) -> Column:
    """A place in a block, from 1, of a number that may be larger than any block."""
    return (F.least(value, F.lit(1 << 20)) + 1).cast("int")


def directory(block: Column, at: Column, order: Column, wanted: dict[str, int]) -> Column:
    """struct of each wanted tag of the directory at a place of a block (struct of type, count, value and payload; null where it isn't there),
    and damage, as the table function tags tells it (a damaged directory's tags may be null). All null for a null block or order."""
    little, place = order == "<", F.least(at.cast("long"), F.lit(1 << 20)).cast("int")

    def entry(here: Column) -> Column:
        fields = {"tag": (0, 2), "type": (2, 2), "count": (4, 4), "value": (8, 4)}
        return F.struct(*(C.unsigned(block, here + k, n, little).alias(name) for name, (k, n) in fields.items()), F.substr(block, here + 9, F.lit(4)).alias("payload"))

    def read(n: Column) -> Column:
        long = (n > T.MAX_TAGS) | (place + 2 + 12 * n > F.octet_length(block))
        rows = F.when((n > 0) & ~long, F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda k: entry(place + 2 + 12 * k)))
        return let(rows, lambda rows: let(rows["tag"], lambda tags: found(n, long, rows, tags)))

    def found(n: Column, long: Column, rows: Column, tags: Column) -> Column:
        bad = F.get(F.filter(rows, lambda r, k: ~r["type"].isin(*T.TYPES) | (F.array_position(tags, r["tag"]) <= k)), F.lit(0))
        fault = F.when(bad["type"].isin(*T.TYPES), "a tag repeats").when(bad.isNotNull(), "unknown field type")
        damage = F.when(n.isNull(), "a directory lies outside").when(long, "a directory is too long").otherwise(fault)
        return F.struct(*(F.get(F.filter(rows, lambda r: r["tag"] == tag), F.lit(0)).alias(name) for name, tag in wanted.items()), damage.alias("damage"))  # noqa: B023

    return F.when(block.isNotNull() & order.isNotNull(), let(C.unsigned(block, place, 2, little), read))


def _block(leading: Column, marker: int, name: bytes) -> Column:
    """struct(damage, blocks, start, block, order) of leading segments: how many blocks of a kind, the last one's start, content and byte order."""
    # of the two kinds of blocks, a segment's size tells which name stood before its block
    mine = F.filter(leading, lambda s: (s["marker"] == marker) & (F.octet_length(s["block"]) + len(name) == s["size"]))
    last = lambda blocks: F.try_element_at(blocks, F.lit(-1))
    damage = F.try_element_at(leading, F.lit(-1))["damage"]
    return let(mine, lambda m: F.struct(damage.alias("damage"), F.size(m).alias("blocks"), last(m)["start"].alias("start"), last(m)["block"].alias("block"), _order(last(m)["block"]).alias("order")))


def _index(leading: Column, length: Column) -> Column:
    """struct(start1, size1, error) of a file's leading segments: places of the second picture, or what is wrong."""
    wanted = {"version": VERSION_TAG, "count": COUNT_TAG, "entries": ENTRIES_TAG}

    def judged(one: Column, tags: Column, table: Column) -> Column:
        little, value = one["order"] == "<", tags["entries"]["value"]
        number = lambda k, at: C.unsigned(table, k * ENTRY + at, 4, little)
        names = ("kind", 0), ("size", 4), ("at", 8)
        return let(F.struct(*(number(k, at).alias(f"{name}{k}") for k in range(2) for name, at in names)), lambda e: said(one, tags, value, e))

    def said(one: Column, tags: Column, value: Column, e: Column) -> Column:
        # where the block of tags lies in the file: behind the segment's name
        start1 = one["start"] + 4 + e["at1"]
        other = lambda kind: (kind.bitwiseAND(0xFFFFFF) != PICTURE_KIND) | (F.shiftright(kind, 24).bitwiseAND(7) != 0)
        tag = lambda name, kind, count: tags[name].isNull() | (tags[name]["type"] != kind) | (tags[name]["count"] != count)
        error = _first(
            (one["damage"].isNotNull(), "damaged segments"), (one["blocks"] != 1, "no stereo index"), (one["order"].isNull(), "no byte order"),
            (C.unsigned(one["block"], 4, 4, one["order"] == "<") != 8, "the first directory is elsewhere"), (tags["damage"].isNotNull(), "damaged tags"),
            (tag("version", UNDEFINED, 4) | (tags["version"]["payload"] != F.lit(VERSION)), "another version"), (tag("count", LONG, 1) | (tags["count"]["value"] != 2), "not two images"),
            (tag("entries", UNDEFINED, 2 * ENTRY), "no entry table"), ((value <= 8) | (value + 2 * ENTRY > F.octet_length(one["block"])), "the entry table lies outside"),
            (other(e["kind0"]) | other(e["kind1"]), "another kind of image"), (e["at0"] != 0, "the first image is elsewhere"),
            ((e["size0"] != start1) | (start1 + e["size1"] > length), "the sizes don't add up"),
        )
        what = lambda error: F.when(error.isNotNull(), F.coalesce(one["damage"], tags["damage"], error))
        return let(error, lambda error: F.struct(F.when(error.isNull(), e["size0"]).alias("start1"), F.when(error.isNull(), e["size1"]).alias("size1"), what(error).alias("error")))

    def read(one: Column) -> Column:
        table = lambda tags: F.substr(one["block"], _place(tags["entries"]["value"]), F.lit(2 * ENTRY))
        return let(directory(one["block"], F.lit(8), one["order"], wanted), lambda tags: let(table(tags), lambda table: judged(one, tags, table)))

    return let(_block(leading, INDEXED, b"MPF\0"), read)


def _parallax(leading: Column) -> Column:
    """struct(num, den, error) of a picture's leading segments: the parallax of the maker's note; null without one."""
    pointer = lambda tag, kind, count: tag.isNotNull() & ((tag["type"] != kind) | (F.lit(False) if count is None else tag["count"] != count))

    def first(one: Column) -> Column:
        return let(directory(one["block"], F.lit(8), one["order"], {"exif": EXIF_TAG}), lambda d0: second(one, d0))

    def second(one: Column, d0: Column) -> Column:
        block = F.when(d0["exif"].isNotNull(), one["block"])
        return let(directory(block, d0["exif"]["value"], one["order"], {"maker": MAKER_TAG}), lambda d1: note(one, d0, d1))

    def note(one: Column, d0: Column, d1: Column) -> Column:
        value = F.substr(one["block"], _place(d1["maker"]["value"]), F.least(d1["maker"]["count"], F.lit(1 << 16)).cast("int"))
        return let(value, lambda v: let(F.when(F.startswith(v, F.lit(MAKER)), v), lambda v: third(one, d0, d1, v)))

    def third(one: Column, d0: Column, d1: Column, v: Column) -> Column:
        return let(directory(v, F.lit(12), F.lit("<"), {"parallax": PARALLAX_TAG}), lambda d2: judged(one, d0, d1, v, d2))

    def judged(one: Column, d0: Column, d1: Column, v: Column, d2: Column) -> Column:
        at = _place(d2["parallax"]["value"]) - 1
        num, den = C.signed32(v, at, True), C.signed32(v, at + 4, True)
        some, head = one["block"].isNotNull(), C.unsigned(one["block"], 4, 4, one["order"] == "<")
        error = _first(
            (one["damage"].isNotNull(), "damaged segments"), (one["blocks"] > 1, "several tag blocks"), (some & one["order"].isNull(), "no byte order"), (some & F.coalesce(head != 8, F.lit(True)), "the first directory is elsewhere"),
            (d0["damage"].isNotNull(), "damaged tags"), (pointer(d0["exif"], LONG, 1), "a tag of another kind"), (d1["damage"].isNotNull(), "damaged tags"), (pointer(d1["maker"], UNDEFINED, None), "a tag of another kind"),
            (v.isNotNull() & F.coalesce(C.unsigned(v, 8, 4, True) != 12, F.lit(True)), "the maker's directory is elsewhere"), (d2["damage"].isNotNull(), "damaged tags"),
            (pointer(d2["parallax"], SRATIONAL, 1), "a tag of another kind"), (d2["parallax"].isNotNull() & (num.isNull() | den.isNull()), "the parallax lies outside"),
        )
        what = lambda error: F.when(error.isNotNull(), F.coalesce(one["damage"], d0["damage"], d1["damage"], d2["damage"], error))
        return let(error, lambda error: F.struct(F.when(error.isNull(), num).alias("num"), F.when(error.isNull(), den).alias("den"), what(error).alias("error")))

    return let(_block(leading, TAGGED, b"Exif\0\0"), first)


def with_stereo(rows: DataFrame, content: Column) -> DataFrame:
    """rows with what a content says as stereo: a struct of n_images, start0, size0, start1, size1, parallax, parallax_px (null without one,
    or with a denominator of 0) and error. _leading, the content's leading sections, and _length stay beside it."""
    rows = rows.withColumns({"_content": content, "_length": F.coalesce(F.octet_length(content), F.lit(0)).cast("long")})
    rows = rows.withColumn("_leading", T.leading("_content")).withColumn("_index", _index(F.col("_leading"), F.col("_length")))
    sound = F.col("_index.error").isNull()
    second = F.substr("_content", (F.col("_index.start1") + 1).cast("int"), F.col("_index.size1").cast("int"))
    rows = rows.withColumn("_second", T.leading(F.when(sound, second))).withColumn("_note", F.when(sound, _parallax(F.col("_second"))))
    error = F.coalesce("_index.error", "_note.error")
    fine, of = error.isNull(), lambda c: F.when(error.isNull(), c)
    value = F.when(fine & (F.col("_note.den") != 0), F.col("_note.num").cast("double") / F.col("_note.den"))
    start1, size1 = of(F.col("_index.start1")), of(F.col("_index.size1"))
    said = {"n_images": of(F.lit(2)), "start0": of(F.lit(0).cast("long")), "size0": start1, "start1": start1, "size1": size1, "parallax": value, "parallax_px": PIXELS * value, "error": error}
    return rows.withColumn("stereo", F.struct(*(c.alias(n) for n, c in said.items()))).drop("_content", "_index", "_second", "_note")


def parse_stereo(files: DataFrame) -> DataFrame:
    """files (path, content) -> one row each: path and the fields of with_stereo."""
    return with_stereo(files.select("path", "content"), F.col("content")).select("path", "stereo.*")


def debug_scan(files: DataFrame) -> DataFrame:
    """A stricter second look at files (path, content): path, directories (of the index, chained ones too) and verdict, which is null for a
    container of which no byte is left over, whose second picture is one and whose chained directories can be read."""
    rows = with_stereo(files.select("path", "content"), F.col("content")).drop("content").withColumn("_one", _block(F.col("_leading"), INDEXED, b"MPF\0"))
    rows = rows.withColumn("_chain", T.chained(F.when(F.col("_one.blocks") == 1, F.col("_one.block")), F.col("_one.order")))
    last = F.try_element_at("_chain", F.lit(-1))
    # a directory without tags has no row, unless another one or damage is behind it
    verdict = F.coalesce("stereo.error", F.when(F.col("stereo.size0") + F.col("stereo.size1") != F.col("_length"), "bytes are left over"), last["damage"])
    return rows.select("path", F.coalesce(last["directory"] + 1, F.lit(0)).alias("directories"), verdict.alias("verdict"))
