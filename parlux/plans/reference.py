"""Queries over the driver's tables, which stand in for photographs, albums, frames and urls (orders are albums, their lines photographs,
events are frames, pages' urls are links, scaled embeddings are pixels), each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlux.functions import columns as C
from parlux.operators import relational as R
from parlux.sources import services as S
from parlux.streaming import flows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Milliseconds after which a cluster of frames is closed.
CLUSTER_MS = 300


def query(sql: str):
    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("""SELECT o_orderkey AS album, count(*) AS photos, CAST(count(*) AS VARCHAR) || CASE WHEN count(*) = 1 THEN ' photo' ELSE ' photos' END AS label, min(p_name) AS first_title
FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY o_orderkey""")
def album_summary(t):
    """Photographs of each album, with the label that an album list shows."""
    photos = t("lineitem").select("l_orderkey", "l_partkey").join(t("part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    rows = photos.join(t("orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    n = F.count("*")
    return rows.groupBy(F.col("o_orderkey").alias("album")).agg(n.alias("photos"), F.concat(n.cast("string"), F.when(n == 1, " photo").otherwise(" photos")).alias("label"), F.min("p_name").alias("first_title"))


@query("""SELECT l_orderkey AS album, l_linenumber AS place, p_name AS title, row_number() OVER (PARTITION BY l_orderkey ORDER BY p_name, l_linenumber) AS rank
FROM lineitem JOIN part ON l_partkey = p_partkey""")
def titles_in_order(t):
    """Photographs of an album sorted by title."""
    from pyspark.sql import Window

    rows = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("album"), F.col("l_linenumber").alias("place"), F.col("p_name").alias("title"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("album").orderBy("title", "place")).cast("long"))


@query("""SELECT doc_id, quality FROM labels UNION ALL SELECT doc_id, CAST(NULL AS INTEGER) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def append_if_absent(t):
    """Photographs that are not in a list yet are appended; repeats within the new ones stay."""
    have = t("labels").select("doc_id", "quality")
    return R.append_absent(have, t("documents").select("doc_id", F.lit(None).cast(have.schema["quality"].dataType).alias("quality")), ["doc_id"])


@query("""WITH c AS (SELECT c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS c_mktsegment FROM customer WHERE c_nationkey > 4),
s AS (SELECT s_nationkey, CASE WHEN s_suppkey % 2 = 0 THEN 'BUILDING' END AS segment FROM supplier)
SELECT * FROM c UNION ALL SELECT s_nationkey, segment FROM s WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.c_nationkey IS NOT DISTINCT FROM s.s_nationkey AND c.c_mktsegment IS NOT DISTINCT FROM s.segment)""")
def append_albums(t):
    """Albums are compared field by field, null equal to null; those of the first nations are in no list yet."""
    have = t("customer").where("c_nationkey > 4").select("c_nationkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    new = t("supplier").select(F.col("s_nationkey").alias("c_nationkey"), F.when(F.col("s_suppkey") % 2 == 0, "BUILDING").alias("c_mktsegment"))
    return R.append_absent(have, new, ["c_nationkey", "c_mktsegment"], null_safe=True)


@query("""SELECT p_brand, p_partkey, score FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY small, score, p_partkey) AS r FROM (
SELECT p_brand, p_partkey, NOT (p_size >= 25 AND p_retailprice >= 1200) AS small, abs(p_size - 25) + abs(p_retailprice - 1200) AS score FROM part)) WHERE r = 1""")
def best_thumbnail(t):
    """The thumbnail nearest to the wanted size; large enough ones go first, ties to the first."""
    return R.best_fit(t("part"), ["p_brand"], F.col("p_size"), F.col("p_retailprice"), 25, 1200, "p_partkey")


_MS = "CAST(floor(value) AS BIGINT) % 100"


@query(f"""SELECT user_id, event_id, {_MS} AS ms, CAST(coalesce(sum({_MS}) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS time FROM events""")
def frame_times(t):
    """The time at which each frame of a video begins."""
    rows = t("events").select("user_id", "event_id", "ts", (F.floor("value").cast("long") % 100).alias("ms"))
    return R.exclusive_sum(rows, ["user_id"], ["ts", "event_id"], F.col("ms"), "time").drop("ts")


@query(f"""WITH RECURSIVE e AS (SELECT user_id, event_id, {_MS} AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
w(user_id, event_id, k, s, cluster, c_next, before) AS (
  SELECT user_id, event_id, k, CASE WHEN ms >= {CLUSTER_MS} THEN 0 ELSE ms END, 0, CASE WHEN ms >= {CLUSTER_MS} THEN 1 ELSE 0 END, CAST(0 AS BIGINT) FROM e WHERE k = 1
  UNION ALL SELECT e.user_id, e.event_id, e.k, CASE WHEN w.s + e.ms >= {CLUSTER_MS} THEN 0 ELSE w.s + e.ms END, w.c_next, w.c_next + CASE WHEN w.s + e.ms >= {CLUSTER_MS} THEN 1 ELSE 0 END, CAST(w.s AS BIGINT)
  FROM w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1)
SELECT user_id, event_id, cluster, before AS time FROM w""")
def frame_clusters(t):
    """Frames of a video in clusters, each closed once it has lasted long enough, with their time in the cluster."""
    return R.clusters(t("events"), ["user_id"], ["ts", "event_id"], F.floor("value").cast("long") % 100, CLUSTER_MS).drop("ts")


@query(f"""SELECT user_id, count(*) AS frames, CAST(sum({_MS}) AS BIGINT) AS duration, bool_and({_MS} > 0) AS sound FROM events GROUP BY user_id""")
def video_duration(t):
    """Frames and length of each video, and whether every frame lasts."""
    ms = F.floor("value").cast("long") % 100
    return t("events").groupBy("user_id").agg(F.count("*").alias("frames"), F.sum(ms).alias("duration"), F.bool_and(ms > 0).alias("sound"))


@query("""SELECT l_orderkey, l_linenumber, coalesce(lag(l_linenumber) OVER w, l_linenumber) AS prev, coalesce(lead(l_linenumber) OVER w, l_linenumber) AS next
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)""")
def next_and_previous(t):
    """The photographs beside each one, clamped at the album's ends."""
    return R.neighbours(t("lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey"], ["l_linenumber"], "l_linenumber")


@query("""SELECT u.conv_id, u.turn AS request, a.turn AS response FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'""")
def responses(t):
    """Requests with their responses, one to one."""
    rows = t("conversations").select("conv_id", "turn", "role")
    asked = rows.where("role = 'user'").select("conv_id", F.col("turn").alias("request"), (F.col("turn") + 1).alias("response"))
    return asked.join(rows.where("role = 'assistant'").select("conv_id", F.col("turn").alias("response")), ["conv_id", "response"]).select("conv_id", "request", "response")


@query("""SELECT doc_id, 'data:text/plain;base64,' || to_base64(encode(text)) AS url, length(encode(text)) AS n_bytes FROM documents WHERE text IS NOT NULL""".replace("length(encode", "octet_length(encode"))
def data_urls(t):
    """Texts as data URLs and the size of what these decode to."""
    rows = t("documents").where("text is not null").select("doc_id", C.data_url(F.lit("text/plain"), F.encode("text", "UTF-8")).alias("url"))
    return rows.withColumn("n_bytes", F.octet_length(C.data_url_bytes(F.col("url"))).cast("long"))


@query("""SELECT page_id, regexp_replace(url, '/([^/]*)$', '/d/\\1') AS download FROM pages""")
def download_urls(t):
    return t("pages").select("page_id", C.download_url(F.col("url")).alias("download"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def json_property(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""SELECT c_custkey, regexp_replace(coalesce(CAST(c_custkey AS VARCHAR), '') || '/' || CASE WHEN c_custkey % 2 = 0 THEN CAST(c_nationkey AS VARCHAR) ELSE '' END || '/' || CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE '' END || '/', '/+$', '') AS token,
c_custkey % 2 = 0 OR c_custkey % 3 = 0 AS valid, CASE WHEN c_custkey % 2 = 0 OR c_custkey % 3 = 0 THEN CAST(c_custkey AS VARCHAR) END AS owner, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_nationkey AS VARCHAR) END AS album_id, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS album FROM customer""")
def album_tokens(t):
    """Album links from their parts and back; without album and id there is no link."""
    key, null = F.col("c_custkey"), F.lit(None).cast("string")
    token = C.album_token(key.cast("string"), F.when(key % 2 == 0, F.col("c_nationkey").cast("string")), F.when(key % 3 == 0, F.col("c_mktsegment")), null)
    rows = t("customer").select("c_custkey", token.alias("token"), C.parse_album_token(token).alias("t"))
    return rows.select("c_custkey", "token", F.col("t").isNotNull().alias("valid"), F.col("t.user").alias("owner"), "t.album_id", "t.album")


@query("""SELECT p_partkey, p_partkey % 2 = 0 OR (p_partkey % 3 = 0 AND (ends_with(lower(name), '.mpo') OR contains(lower(name), '.mpo.'))) AS stereo, p_partkey % 4 = 0 OR p_partkey % 2 = 1 AND p_partkey % 3 = 0 AS supported
FROM (SELECT p_partkey, p_name || CASE WHEN p_size % 2 = 0 THEN '.MPO' ELSE '.jpg' END AS name FROM part)""")
def stereo_candidates(t):
    """Files that may hold a stereo photograph, by type and name."""
    key = F.col("p_partkey")
    mime = F.when(key % 4 == 0, "image/mpo").when(key % 2 == 0, "").when(key % 3 == 0, "image/jpeg").otherwise("text/plain")
    name = F.concat("p_name", F.when(F.col("p_size") % 2 == 0, ".MPO").otherwise(".jpg"))
    return t("part").select("p_partkey", C.maybe_stereo(mime, name).alias("stereo"), C.supported_mime(mime).alias("supported"))


_WIDE = "(l_partkey + 1) * (1::BIGINT << (4 * l_linenumber))"


@query(f"""SELECT l_orderkey, l_linenumber, CASE WHEN length(hex(v)) % 2 = 1 THEN '0' ELSE '' END || hex(v) AS id, lpad(hex(v + (1::BIGINT << (7 * w))), 2 * w, '0') AS size, CASE WHEN length(hex(v)) <= 8 THEN lpad(hex(v), 8, '0') END AS number FROM (
SELECT *, CASE WHEN v = 1 THEN 1 ELSE CAST(ceil(length(bin(v - 1)) / 8.0) AS INTEGER) + 1 END AS w FROM (SELECT l_orderkey, l_linenumber, {_WIDE} AS v FROM lineitem))""")
def ebml_numbers(t):
    """Ids, variable-length sizes and fixed-width numbers of a container, of one byte to six."""
    v = (F.col("l_partkey") + 1) * F.pow(F.lit(16), F.col("l_linenumber")).cast("long")
    return t("lineitem").select("l_orderkey", "l_linenumber", C.ebml_id(v).alias("id"), C.ebml_size(v).alias("size"), C.ebml_number(v, 4).alias("number"))


def _level(x: Column) -> Column:
    return F.floor(F.least(F.greatest(x.cast("double"), F.lit(-1.0)), F.lit(1.0)) * 127 + 128).cast("int")


_LEVELS = "list_transform(embedding, lambda x: CAST(floor(least(greatest(CAST(x AS DOUBLE), -1), 1) * 127 + 128) AS INTEGER))"


@query(f"""SELECT vec_id, (16839 * v[1] + 33059 * v[2] + 6420 * v[3] + 1081344) >> 16 AS y,
greatest(0, least(255, (-9719 * s * v[1] - 19081 * s * v[2] + 28800 * s * v[3] + 33685504) >> 18)) AS u, greatest(0, least(255, (28800 * s * v[1] - 24116 * s * v[2] - 4684 * s * v[3] + 33685504) >> 18)) AS v
FROM (SELECT vec_id, {_LEVELS} AS v, 4 AS s FROM embeddings)""")
def pixel_colours(t):
    """Luma of a pixel and chroma of four equal ones."""
    r, g, b = (_level(F.get("embedding", F.lit(k))) for k in range(3))
    u, v = C.chroma(4 * r, 4 * g, 4 * b)
    return t("embeddings").select("vec_id", C.luma(r, g, b).alias("y"), u.alias("u"), v.alias("v"))


@query(f"""SELECT level, count(*) AS n FROM (SELECT unnest({_LEVELS}) AS level FROM embeddings) GROUP BY level""")
def histogram(t):
    """How often each of 256 levels occurs."""
    return t("embeddings").select(F.explode(F.transform("embedding", _level)).alias("level")).groupBy("level").agg(F.count("*").alias("n"))


@query(f"""SELECT vec_id, list_reduce(list_prepend(CAST(0 AS BIGINT), {_LEVELS}), lambda a, v: abs(xor((3 * a + abs(v) + 1) & 4294967295, 2147483648) - 2147483648)) AS checksum FROM embeddings""")
def checksums(t):
    """An order-sensitive checksum of each row of levels."""
    return t("embeddings").select("vec_id", C.fold_checksum(F.transform("embedding", _level)).alias("checksum"))


@query("""SELECT p_partkey, CAST(floor((640 - w) / 2.0) AS BIGINT) AS "left", CAST(floor((480 - h) / 2.0) AS BIGINT) AS top, w AS width, h AS height FROM (
SELECT p_partkey, CAST(CASE WHEN tall <= 480 THEN 640 ELSE ceil(480 * pw / ph) END AS BIGINT) AS w, CAST(CASE WHEN tall <= 480 THEN tall ELSE 480 END AS BIGINT) AS h FROM (
SELECT p_partkey, p_size + 1.0::DOUBLE AS pw, floor(p_retailprice / 40) + 1 AS ph, ceil(640 * (floor(p_retailprice / 40) + 1) / (p_size + 1.0::DOUBLE)) AS tall FROM part))""")
def aspect_fit(t):
    """Pictures fitted into a window and centred."""
    left, top, w, h = C.aspect_fit(F.col("p_size") + F.lit(1.0), F.floor(F.col("p_retailprice") / 40) + 1, F.lit(640), F.lit(480))
    return t("part").select("p_partkey", left.alias("left"), top.alias("top"), w.alias("width"), h.alias("height"))


@query(f"""SELECT page_id, coalesce(regexp_matches(CASE page_id % 4 WHEN 0 THEN 'https://lh' || page_id || '.googleusercontent.com/' || url WHEN 1 THEN 'https://picasaweb.google.com/' || url WHEN 2 THEN 'http://picasaweb.google.com/' || url ELSE url END, '{S.RELAYED}'), false) AS allowed FROM pages""")
def relayed(t):
    """Addresses that may be relayed: pages' own, and those with three services' addresses before them."""
    key = F.col("page_id") % 4
    url = F.when(key == 0, F.concat(F.lit("https://lh"), "page_id", F.lit(".googleusercontent.com/"), "url")).when(key == 1, F.concat(F.lit("https://picasaweb.google.com/"), "url")).when(key == 2, F.concat(F.lit("http://picasaweb.google.com/"), "url"))
    return t("pages").select("page_id", S.relay_allowed(url.otherwise(F.col("url"))).alias("allowed"))


@query("""SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC, value DESC) AS r FROM events WHERE value IS NOT NULL) WHERE r = 1""")
def load_progress(t):
    """The last report of each load."""
    return flows.progress(t("events").select("user_id", "event_id", "value", "ts"), "user_id", "event_id", "value", "ts")


@query(f"""SELECT event_id, CASE WHEN event_id % 12 < 10 THEN ({flows.LEVELS})[event_id % 12 + 1] ELSE 'INFO' END AS level FROM events""")
def log_levels(t):
    """Levels of relayed log records, some of them unknown or absent."""
    names = F.array(*(F.lit(n) for n in flows.LEVELS), F.col("event_type"))
    return t("events").select("event_id", flows.log_level(F.get(names, (F.col("event_id") % 12).cast("int"))).alias("level"))


@query("""SELECT c_custkey, lst AS preference FROM (SELECT o_custkey AS c_custkey, o_orderstatus AS lst, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""")
def preferences(t):
    """A store of preferences: the last write of each key wins."""
    return t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("preference"))
