"""Queries over stereo containers and pictures that are made byte by byte from the rows of tables: sound ones of both byte orders, with and
without a maker's note, and each kind of damage; each query has SQL that works their places out from the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlux.functions import media as M
from parlux.functions import tables as T
from parlux.operators import stereo as S
from parlux.plans.reference import query
from parlux.sources import files


def _int(value: Column | int, size: int, little: Column | bool = False) -> Column:
    """A number as so many bytes; negative ones as their complement."""
    value = value if isinstance(value, Column) else F.lit(value)
    digits = F.lpad(F.hex(value.cast("long").bitwiseAND((1 << 8 * size) - 1)), 2 * size, "0")
    swapped = F.concat(*(F.substr(digits, F.lit(2 * k + 1), F.lit(2)) for k in reversed(range(size))))
    return F.unhex(F.when(little if isinstance(little, Column) else F.lit(little), swapped).otherwise(digits))


def _bytes(text: bytes) -> Column:
    return F.lit(text)


def _segment(marker: int, payload: Column) -> Column:
    return F.concat(_bytes(bytes([0xFF, marker])), _int(F.octet_length(payload) + 2, 2), payload)


def _tag(little: Column | bool, tag: Column | int, kind: Column | int, count: Column | int, payload: Column) -> Column:
    return F.concat(_int(tag, 2, little), _int(kind, 2, little), _int(count, 4, little), payload)


def _spread(rows: DataFrame) -> DataFrame:
    """rows dealt over as many tasks as a shuffle has: few bytes of a table, which Spark reads in few tasks, are much work here."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _files(t) -> DataFrame:
    """Containers of parts with a name and a type for pictures. k (0 to 15): from 8 on a container is damaged in a way each; 2, 3, 6 and 7
    have no maker's note; 7 has bytes left over."""
    size, k, little = F.col("p_size"), F.col("k"), F.col("little")
    number = lambda v, n=4: _int(v, n, little)
    rows = _spread(t("part")).select(F.col("p_partkey").alias("path"), (F.col("p_partkey") % 16).alias("k"), (size % 2 == 0).alias("little"), F.encode("p_name", "UTF-8").alias("first"), F.encode("p_type", "UTF-8").alias("second"), (size - 25).alias("num"), (size % 5 - 1).alias("den"))
    start = F.concat(F.when(little, _bytes(b"II*\0")).otherwise(_bytes(b"MM\0*")), number(8))
    note = F.concat(_bytes(b"FUJIFILM"), _int(12, 4, True), _int(1, 2, True), _tag(True, 45585, 10, 1, _int(26, 4, True)), _int(F.col("num"), 4, True), _int(F.col("den"), 4, True))
    tagged = F.concat(_bytes(b"Exif\0\0"), start, number(1, 2), _tag(little, 34665, 4, 1, number(22)), number(1, 2), _tag(little, 37500, 7, 34, number(36)), note)
    picture = lambda text: F.concat(_segment(0xDB, F.col(text)), _bytes(b"\xff\xd9"))
    # each step is used more than once by the next one
    rows = rows.withColumn("tagged", tagged).withColumn("app1", F.when(k.isin(2, 3, 6, 7), _bytes(b"")).otherwise(_segment(0xE1, F.col("tagged"))))
    rows = rows.withColumn("other", F.concat(_bytes(b"\xff\xd8"), "app1", picture("second"))).withColumns({"n_other": F.octet_length("other"), "n_first": F.octet_length("first") + 94})
    version = _tag(little, 45056, F.when(k == 13, 6).otherwise(7), 4, F.when(k == 9, _bytes(b"0101")).otherwise(_bytes(b"0100")))
    count = _tag(little, F.when(k == 12, 45056).otherwise(45057), 4, 1, number(F.when(k == 8, 3).otherwise(2)))
    entry = lambda kind, n, at: F.concat(number(kind), number(n), number(at), number(0))
    entries = F.concat(entry(F.when(k == 10, 0x030000).otherwise(0x020002), F.when(k == 11, F.col("n_first") + 1).otherwise(F.col("n_first")), F.lit(0)), entry(F.lit(0x020002), F.col("n_other"), F.col("n_first") - 10))
    rows = rows.withColumn("index", F.concat(_bytes(b"MPF\0"), start, number(3, 2), version, count, _tag(little, 45058, 7, 32, number(46)), entries))
    rows = rows.withColumn("whole", F.concat(_bytes(b"\xff\xd8"), _segment(0xE2, F.col("index")), picture("first"), "other", F.when(k == 7, _bytes(b"xyz")).otherwise(_bytes(b""))))
    return rows.select("path", F.when(k == 14, F.substr("whole", F.lit(1), F.lit(40))).when(k == 15, F.col("first")).otherwise(F.col("whole")).alias("content"))


_SOUND = "k < 8"
_LENGTHS = "SELECT *, p_partkey % 16 AS k, 94 + octet_length(encode(p_name)) AS size0, CASE WHEN p_partkey % 16 IN (2, 3, 6, 7) THEN 8 ELSE 88 END + octet_length(encode(p_type)) AS size1 FROM part"


@query(f"""SELECT p_partkey AS path, CASE WHEN {_SOUND} THEN 2 END AS n_images, CASE WHEN {_SOUND} THEN CAST(size0 AS BIGINT) END AS start1, CASE WHEN {_SOUND} THEN CAST(size1 AS BIGINT) END AS size1,
CASE WHEN {_SOUND} AND k NOT IN (2, 3, 6, 7) AND p_size % 5 <> 1 THEN CAST(p_size - 25 AS DOUBLE) / (p_size % 5 - 1) * 35 END AS parallax_px,
CASE k WHEN 8 THEN 'not two images' WHEN 9 THEN 'another version' WHEN 10 THEN 'another kind of image' WHEN 11 THEN 'the sizes don''t add up' WHEN 12 THEN 'a tag repeats' WHEN 13 THEN 'unknown field type' WHEN 14 THEN 'a segment''s length is wrong' WHEN 15 THEN 'no stereo index' END AS error
FROM ({_LENGTHS})""")
def stereo_containers(t):
    """What the sections, tags and entries of containers say: places and sizes of pictures, the parallax, or what is wrong."""
    found = S.parse_stereo(_files(t))
    return found.select("path", "n_images", "start1", "size1", "parallax_px", F.when(F.col("error") == "no start of image", "no stereo index").otherwise(F.col("error")).alias("error"))


@query(f"""SELECT p_partkey AS path, k < 7 AS complete, CASE WHEN k < 14 THEN CASE WHEN k = 12 OR k = 13 THEN 1 ELSE 2 END ELSE 0 END AS directories FROM ({_LENGTHS})""")
def scanned_containers(t):
    """Containers that a stricter scan finds complete, and the directories of their index: behind the index's tags stand the first picture's
    kind and size, which are read as a chain's next place and lead outside."""
    found = S.debug_scan(_files(t))
    left = F.col("verdict").isNull() | (F.col("verdict") == "a directory lies outside")
    return found.select("path", left.alias("complete"), "directories")


def _pictures(t) -> DataFrame:
    """Pictures of suppliers: a name's segment, tables, a frame, restarts, and scans whose data hold stuffed bytes."""
    name, key = F.encode("s_name", "UTF-8"), F.col("s_suppkey")
    scan = F.concat(_segment(0xDA, _bytes(b"abcd")), name, _bytes(b"\xff\x00"), name, _bytes(b"\xff\xd3"), name)
    scans = F.when(key % 3 == 0, scan).when(key % 3 == 1, F.concat(scan, scan)).otherwise(F.concat(scan, _segment(0xC4, name), scan, scan))
    end = F.when(key % 4 == 3, _bytes(b"")).otherwise(_bytes(b"\xff\xd9"))
    whole = F.concat(_bytes(b"\xff\xd8"), _segment(0xE0, name), _segment(0xDB, F.encode(F.repeat("s_name", (key % 7 + 1).cast("int")), "UTF-8")), _segment(0xC0, name), _segment(0xDD, _bytes(b"ab")), scans, end)
    return _spread(t("supplier")).select(key.alias("path"), whole.alias("content"))


@query("""WITH p AS (SELECT s_suppkey AS path, octet_length(encode(s_name)) AS n, s_suppkey % 3 AS m, s_suppkey % 4 <> 3 AS ends, s_suppkey % 7 + 1 AS r FROM supplier),
s AS (SELECT path, ends, n, unnest(list_concat([{'marker': 224, 'size': n, 'data': 0}, {'marker': 219, 'size': n * r, 'data': 0}, {'marker': 192, 'size': n, 'data': 0}, {'marker': 221, 'size': 2, 'data': 0}, {'marker': 218, 'size': 4, 'data': 3 * n + 4}],
  CASE m WHEN 1 THEN [{'marker': 218, 'size': 4, 'data': 3 * n + 4}] WHEN 2 THEN [{'marker': 196, 'size': n, 'data': 0}, {'marker': 218, 'size': 4, 'data': 3 * n + 4}, {'marker': 218, 'size': 4, 'data': 3 * n + 4}] ELSE [] END,
  CASE WHEN ends THEN [{'marker': 217, 'size': 0, 'data': 0}] ELSE [{'marker': NULL, 'size': NULL, 'data': 0}] END)) AS x, generate_subscripts(list_concat([1, 2, 3, 4, 5], CASE m WHEN 1 THEN [6] WHEN 2 THEN [6, 7, 8] ELSE [] END, [9]), 1) - 1 AS seq FROM p)
SELECT path, CAST(seq AS INTEGER) AS seq, CAST(x.marker AS INTEGER) AS marker, CAST(x.size AS BIGINT) AS size, seq = 0 AS leading, CASE WHEN x.marker IS NULL THEN 'the scan does not end' END AS damage,
CASE WHEN x.marker IS NOT NULL THEN CAST(2 + coalesce(sum(x.size + 4 + x.data) OVER (PARTITION BY path ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) END AS start
FROM s""")
def marker_sections(t):
    """The sections of pictures, scans and restarts among them, and pictures of which the last scan does not end. start is the marker's place."""
    read = _pictures(t).select("path", T.walked("content").alias("sections")).select("path", F.inline("sections"))
    # the tables' marker is one of those that a decoder needs
    needed = M.is_section_marker(F.unhex(F.concat(F.lit("FF"), F.lpad(F.hex("marker"), 2, "0"))))
    return read.where(needed | F.col("marker").isNull() | F.col("marker").isin(0xE0, 0xD9)).select("path", "seq", "marker", "size", "leading", "damage", F.when(F.col("damage").isNull(), F.col("at")).alias("start"))


@query(f"""SELECT p_partkey AS path, CASE WHEN {_SOUND} THEN 'image/mpo' WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN 'image/mpo' ELSE 'image/jpeg' END AS mime,
CASE WHEN {_SOUND} THEN 2 WHEN p_partkey % 3 < 2 THEN NULL ELSE 1 END AS images, CASE WHEN {_SOUND} THEN CAST(size1 AS BIGINT) END AS second FROM ({_LENGTHS})""")
def opened_files(t):
    """What files show that may be containers: by type, without one, or by name."""
    kind = F.col("path") % 3
    rows = _files(t).select("path", F.concat("path", F.lit(".mpo")).alias("name"), F.when(kind == 0, "").when(kind == 1, "image/mpo").otherwise("image/jpeg").alias("mime"), "content")
    seen = files.classified(rows)
    sizes = F.when(F.size("images") == 2, F.element_at("images", 2)["size"])
    return seen.select("path", "mime", F.when(F.col("images").isNotNull(), F.size("images")).alias("images"), sizes.alias("second"))
