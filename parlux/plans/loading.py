"""Queries of loading: files and what they show, feeds and their thumbnails, states of loads, notices. Inputs are made from the driver's
tables so that every outcome occurs, each query with its SQL."""

from __future__ import annotations

import struct

from pyspark.sql import functions as F

from parlux.operators.shared import shared_folder
from parlux.plans.reference import query
from parlux.sources import files, recorded, services
from parlux.streaming import flows


def _container() -> bytes:
    """A small sound stereo container."""
    second = b"\xff\xd8\xff\xdb rest"

    def first(size: int) -> bytes:
        entries = struct.pack("<IIIHH", 0x020002, size, 0, 0, 0) + struct.pack("<IIIHH", 0x020002, len(second), max(0, size - 10), 0, 0)
        tags = [(45056, 7, 4, b"0100"), (45057, 4, 1, struct.pack("<I", 2)), (45058, 7, 32, struct.pack("<I", 46))]
        index = b"MPF\0II*\0" + struct.pack("<IH", 8, 3) + b"".join(struct.pack("<HHI", *t[:3]) + t[3] for t in tags) + entries
        return b"\xff\xd8\xff\xe2" + struct.pack(">H", len(index) + 2) + index + b"\xff\xdb the first image"

    return first(len(first(0))) + second


SAMPLE = _container()
_FIRST, _SECOND = SAMPLE.rindex(b"\xff\xd8"), len(SAMPLE) - SAMPLE.rindex(b"\xff\xd8")


@query(f"""SELECT doc_id, CASE WHEN k < 2 THEN 'image/mpo' WHEN k = 2 THEN 'image/jpeg' WHEN k = 3 THEN 'image/mpo' WHEN k = 4 THEN '' WHEN k = 5 THEN 'image/jpeg' ELSE 'image/png' END AS mime,
CASE WHEN k < 2 THEN 2 WHEN k IN (3, 4) THEN NULL ELSE 1 END AS images, CAST(CASE WHEN k < 2 THEN {_FIRST} WHEN k IN (3, 4) THEN NULL ELSE 0 END AS BIGINT) AS last_start,
CAST(CASE WHEN k < 2 THEN {_SECOND} WHEN k IN (3, 4) THEN NULL WHEN k IN (2, 6) THEN {len(SAMPLE)} + octet_length(encode(text)) ELSE octet_length(encode(text)) END AS BIGINT) AS last_size, k IN (3, 4) AS failed
FROM (SELECT *, doc_id % 7 AS k FROM documents WHERE text IS NOT NULL)""")
def classified_files(t):
    """What files show: sound containers, declared or only named so, others that are not looked at or not sound."""
    k = F.col("doc_id") % 7
    mime = F.when(k.isin(0, 3), "image/mpo").when(k.isin(1, 2, 5), "image/jpeg").when(k == 4, "").otherwise("image/png")
    name = F.concat("doc_id", F.when(k.isin(1, 5), ".MPO").otherwise(".jpg"))
    text = F.encode("text", "UTF-8")
    content = F.when(k.isin(0, 1, 2, 6), F.concat(F.lit(SAMPLE), text)).otherwise(text)
    rows = t("documents").where("text is not null").select(F.col("doc_id").alias("path"), name.alias("name"), mime.alias("mime"), content.alias("content"))
    last = F.element_at("images", -1)
    return files.classified(rows).select(F.col("path").alias("doc_id"), "mime", F.when(F.col("images").isNotNull(), F.size("images")).alias("images"), last["start"].alias("last_start"), last["size"].alias("last_size"), F.col("error").isNotNull().alias("failed"))


def _feeds(t):
    """Feeds of orders' lines: complete ones, ones with a line without title, without entries, no JSON, missing, failed and unanswered."""
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    thumb = lambda width: F.concat(F.lit('{"width":"'), F.lit(width), F.lit('","height":"72","url":"t'), line, F.lit('"}'))
    small = F.when(line == 1, thumb("1")).when(line == 2, F.concat(F.lit("["), thumb("144"), F.lit(","), thumb("x"), F.lit("]")))
    group = F.coalesce(F.concat(F.lit(',"media$group":{"media$thumbnail":'), small, F.lit("}")), F.lit(""))
    title = F.when((key % 8 == 1) & (line == 1), "").otherwise(F.concat(F.lit(',"title":{"$t":"p'), "l_partkey", F.lit('"}')))
    entry = F.concat(F.lit('{"gphoto$id":{"$t":"'), key, F.lit("-"), line, F.lit('"},"content":{"type":"image/jpeg","src":"http://h/'), line, F.lit('"}'), title, group, F.lit("}"))
    lines = t("lineitem").groupBy(key.alias("album_id")).agg(F.array_sort(F.collect_list(F.struct(line.alias("line"), entry.alias("entry")))).alias("entries"))
    kind = F.col("album_id") % 8
    name = F.when(F.col("album_id") % 16 == 0, F.lit("")).otherwise(F.concat(F.lit("feed"), "album_id"))
    feed = F.concat(F.lit('{"feed":{"title":{"$t":"'), name, F.lit('"},"entry":['), F.array_join(F.col("entries.entry"), ","), F.lit("]}}"))
    answer = F.when(kind == 2, F.lit('{"feed":{"title":{"$t":"x"}}}')).when(kind == 3, F.lit("no json")).otherwise(feed)
    status = F.when(kind == 4, 404).when(kind == 5, 500).when(kind != 6, 200)
    return lines.select("album_id", F.lit("given").alias("name"), status.alias("status"), answer.alias("answer"))


#: Feeds that are complete: a line without title is the first of its album, so that albums without a first line have titles for all.
_COMPLETE = "(l_orderkey % 8 IN (0, 7) OR l_orderkey % 8 = 1 AND NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = l.l_orderkey AND x.l_linenumber = 1))"


@query(f"""SELECT DISTINCT l_orderkey AS album_id, CASE WHEN {_COMPLETE} AND l_orderkey % 16 <> 0 THEN 'feed' || l_orderkey ELSE 'given' END AS name,
CASE WHEN {_COMPLETE} THEN 'OK' WHEN l_orderkey % 8 = 4 THEN 'NOT_FOUND' WHEN l_orderkey % 8 = 6 THEN 'NETWORK' ELSE 'UNEXPECTED' END AS kind FROM lineitem l""")
def feed_states(t):
    """Albums of feeds: their names, and what came of loading them."""
    return services.feed_albums(_feeds(t))[0]


@query(f"""SELECT l_orderkey AS album_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey || '"') - 1 AS INTEGER) AS place, l_orderkey || '-' || l_linenumber AS photo_id, 'p' || l_partkey AS title, 'http://h/d/' || l_linenumber AS download_url,
CASE l_linenumber WHEN 1 THEN '1x72 t1' WHEN 2 THEN '144x72 t2|?x72 t2' ELSE '' END AS thumbnails FROM lineitem l WHERE {_COMPLETE}""")
def feed_photographs(t):
    """Photographs of feeds with their thumbnails: none, a single one or a list of them."""
    rows = services.feed_albums(_feeds(t))[1]
    sizes = F.transform("thumbnails", lambda s: F.concat(F.coalesce(s["width"].cast("string"), F.lit("?")), F.lit("x"), s["height"], F.lit(" "), s["url"]))
    return rows.select("album_id", "place", "photo_id", "title", "download_url", F.array_join(sizes, "|").alias("thumbnails"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 END AS n, CASE WHEN p_partkey % 3 <> 0 THEN 220 END AS height, CASE p_partkey % 3 WHEN 1 THEN true WHEN 2 THEN false END AS usual FROM part""")
def listed_thumbnails(t):
    """Thumbnails of listed files: none, or one with an address that ends as it should or not."""
    k = F.col("p_partkey") % 3
    thumbs, usual = services.file_thumbnails(F.when(k == 1, "http://t/1=s220").when(k == 2, "http://t/1=s100"))
    return t("part").select("p_partkey", F.size(thumbs).alias("n"), F.get(thumbs, F.lit(0))["height"].alias("height"), usual.alias("usual"))


_EVENTS = "SELECT user_id * 50 + event_id % 50 AS load, ts, event_id, event_type FROM events"


@query(f"""WITH e AS ({_EVENTS}), f AS (SELECT load, event_type, row_number() OVER (PARTITION BY load ORDER BY ts, CASE event_type WHEN 'purchase' THEN 0 ELSE 1 END) AS r FROM e WHERE event_type IN ('purchase', 'error'))
SELECT load, CASE WHEN NOT bool_or(event_type = 'view') THEN 'PENDING' WHEN (SELECT count(*) FROM f WHERE f.load = e.load) = 0 THEN 'LOADING' WHEN (SELECT any_value(f.event_type) FROM f WHERE f.load = e.load AND r = 1) = 'purchase' THEN 'LOADED' ELSE 'ERROR' END AS state FROM e GROUP BY load""")
def load_states(t):
    """States of loads: a view asks, a purchase ends one well, an error ends it."""
    event = F.when(F.col("event_type") == "view", "asked").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed")
    rows = t("events").select((F.col("user_id") * 50 + F.col("event_id") % 50).alias("load"), event.alias("event"), "ts")
    return flows.load_states(rows, "load", "event", "ts")


@query("""SELECT user_id, event_id, CAST(epoch_us(until) - epoch_us(ts) AS BIGINT) AS seen FROM (
SELECT *, least(ts + to_milliseconds(CASE WHEN event_id % 3 = 0 THEN 5000 ELSE (event_id % 3) * 900000 END), lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS until FROM events) WHERE event_type <> 'signup'""")
def notices_seen(t):
    """For how many microseconds each notice is seen: until the next one, one that hides it, or its time is over."""
    third = F.col("event_id") % 3
    rows = t("events").withColumn("message", F.when(F.col("event_type") != "signup", F.col("event_type")))
    seen = flows.shown(rows, "user_id", "ts", "event_id", "message", F.when(third > 0, third * 900_000))
    return seen.select("user_id", "event_id", (F.unix_micros(F.col("until").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))).alias("seen"))


@query("""SELECT event_id, CAST(floor(floor(value * 10) / 100) % 2 AS INTEGER) AS picture, CASE event_id % 4 WHEN 0 THEN 'OK' WHEN 1 THEN 'DENIED' WHEN 2 THEN 'OK' ELSE 'NOT_FOUND' END AS ended FROM events WHERE value IS NOT NULL""")
def pictures_and_retries(t):
    """Which of two alternating pictures is seen, and what calls end with after a second try."""
    pick = lambda *texts: F.get(F.array(*(F.lit(x) for x in texts)), (F.col("event_id") % 4).cast("int"))
    ended = flows.after_retry(pick("RETRY", "RETRY", "OK", "NOT_FOUND"), pick("OK", "RETRY", None, None))
    return t("events").where("value is not null").select("event_id", flows.alternating(F.floor(F.col("value") * 10)).alias("picture"), ended.alias("ended"))


@query("""WITH f AS (SELECT *, 'n' || s_nationkey AS folder, s_suppkey % 4 AS m, s_nationkey % 5 = 3 AND s_suppkey % 3 = 0 AS missing FROM supplier),
c AS (SELECT folder, bool_and(NOT missing) AS complete FROM f GROUP BY folder)
SELECT n_name AS name, row_number() OVER (PARTITION BY folder ORDER BY s_name, s_suppkey) AS place, 's' || s_suppkey AS photo_id, s_name AS title, CASE m WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/mpo' ELSE 'image/png' END AS mime
FROM f JOIN c USING (folder) JOIN nation ON n_nationkey = s_nationkey WHERE complete AND m < 3""")
def recorded_folders(t):
    """Photographs of folders (nations with their suppliers) from recorded answers: those of supported types, of folders all of whose files
    are recorded."""
    spark, folder, key = t("nation").sparkSession, shared_folder(t("nation").sparkSession, "recording"), F.col("s_suppkey")
    text = lambda **fields: F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())))
    mime = F.get(F.array(*(F.lit(m) for m in ("image/jpeg", "image/mpo", "image/png", "text/plain"))), (key % 4).cast("int"))
    name = lambda kind, c: F.concat(F.lit(kind), c)
    there = t("supplier").where(~((F.col("s_nationkey") % 5 == 3) & (key % 3 == 0)))
    files = there.select(F.lit("files").alias("service"), name("s", key).alias("id"), text(id=name("s", key), title=F.col("s_name"), mimeType=mime).alias("answer"))
    own = t("nation").select(F.lit("files"), name("n", F.col("n_nationkey")), text(id=name("n", F.col("n_nationkey")), title=F.col("n_name"), mimeType=F.lit("folder")))
    children = F.transform(F.array_sort(F.collect_list("s_suppkey")), lambda k: F.struct(F.concat(F.lit("s"), k).alias("id")))
    lists = t("supplier").groupBy("s_nationkey").agg(children.alias("items")).select(F.lit("folders"), name("n", F.col("s_nationkey")), text(kind=F.lit(recorded.LISTING), items=F.col("items")))
    files = files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # a file each, of few bytes of a table
    recorded.record(files.union(own).union(lists), folder).count()
    albums, photos = recorded.load_folders(spark, folder, t("nation").select(name("n", F.col("n_nationkey")).alias("folder_id")))
    return photos.join(albums, "folder_id").select("name", F.col("place").cast("long").alias("place"), "photo_id", "title", "mime")
