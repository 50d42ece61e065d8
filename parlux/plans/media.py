"""More queries over the driver's tables: links and answers made from keys, layouts, merged lists, element trees and blocks of pictures
(scaled embeddings are blocks), each with its SQL. Inputs are made so that every outcome occurs."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlux.functions import columns as C
from parlux.functions import media as M
from parlux.operators import albums as A
from parlux.operators import blocks as B
from parlux.operators import compose as P
from parlux.operators import muxer as X
from parlux.plans.reference import query
from parlux.sources import services as S

@query("""SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'files' WHEN 3 THEN 'files' WHEN 4 THEN 'folder' WHEN 5 THEN 'folder' END AS kind,
CASE c_custkey % 7 WHEN 0 THEN 'a' || c_custkey || '|b' WHEN 3 THEN 'x' || c_custkey || '|y' WHEN 4 THEN 'f' || c_custkey WHEN 5 THEN 'f' END AS ids, CASE c_custkey % 7 WHEN 3 THEN 'y' WHEN 4 THEN 'p' END AS current FROM customer""")
def link_tokens(t):
    """What links open: files of a state or a list, folders, or nothing."""
    key = F.col("c_custkey").cast("string")
    state = lambda text: F.concat(F.lit("http://v.org/?state="), F.url_encode(text))
    kind = F.col("c_custkey") % 7
    url = F.when(kind == 0, state(F.concat(F.lit('{"action":"open","ids":["a'), key, F.lit('","b"]}')))).when(kind == 1, state(F.lit('{"action":"create","ids":["a"]}')))
    url = url.when(kind == 2, F.lit("http://v.org/?state=no+json&googledrivefiles=x")).when(kind == 3, F.concat(F.lit("http://v.org/?googledrivefiles=x"), key, F.lit("%2Fy&file=y")))
    url = url.when(kind == 4, F.concat(F.lit("http://v.org/?googledrivefolder=f"), key, F.lit("&photo=p"))).when(kind == 5, F.lit("http://v.org/?googledrivefolder=f")).otherwise("http://v.org/?other=1")
    token = t("customer").select("c_custkey", M.link_token(url).alias("t"))
    return token.select("c_custkey", "t.kind", F.array_join("t.ids", "|").alias("ids"), "t.current")


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'OK' WHEN 1 THEN 'RETRY' WHEN 2 THEN 'NOT_FOUND' WHEN 3 THEN 'NETWORK' ELSE 'UNEXPECTED' END AS answer,
CASE o_orderkey % 5 WHEN 0 THEN 'OK' WHEN 1 THEN 'NOT_FOUND' WHEN 2 THEN 'UNEXPECTED' WHEN 3 THEN 'UNEXPECTED' ELSE 'NETWORK' END AS status FROM orders""")
def error_classes(t):
    """What services' answers and statuses mean."""
    pick = lambda k, *texts: F.get(F.array(*(F.lit(x) for x in texts)), (F.col("o_orderkey") % k).cast("int"))
    answer = pick(6, '{"id": 1}', '{"error": {"code": 401}}', '{"error": {"code": 404, "message": "x"}}', '{"error": {"code": -1, "message": "a network error"}}', '{"error": {"code": -1, "message": "x"}}', None)
    return t("orders").select("o_orderkey", C.let(answer, lambda a: M.answer_class(a)).alias("answer"), M.status_class(pick(5, 200, 404, 403, 500, None), 404).alias("status"))


@query("""SELECT o_orderkey, 'https://picasaweb.google.com/data/feed/api/user/' || o_custkey || CASE WHEN o_orderkey % 2 = 0 THEN '/albumid/' || o_orderkey ELSE '/album/' || o_orderstatus END || '?alt=json&v=2' || CASE WHEN o_orderkey % 3 = 0 THEN '&authkey=k' || o_orderkey ELSE '' END AS feed,
o_orderkey % 2 = 0 AS allowed FROM orders""")
def feed_urls(t):
    """Addresses of albums' feeds, and which addresses (half of them by another scheme) may be relayed."""
    key = F.col("o_orderkey")
    feed = M.feed_url(F.col("o_custkey").cast("string"), F.when(key % 2 == 0, key.cast("string")), F.col("o_orderstatus"), F.when(key % 3 == 0, F.concat(F.lit("k"), key.cast("string"))))
    sent = F.when(key % 2 == 0, feed).otherwise(F.replace(feed, F.lit("https:"), F.lit("http:")))
    return t("orders").select("o_orderkey", feed.alias("feed"), S.relay_allowed(sent).alias("allowed"))


@query("""SELECT doc_id, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped, coalesce(source, lang, 'x') AS name,
CASE WHEN source IS NOT NULL THEN coalesce(lang || '=x', 'x') WHEN lang IS NOT NULL THEN 'x' END AS value,
array_to_string(list_prepend(substr(text, 1, 73), list_transform(range(CAST(greatest(0, ceil((length(text) - 73) / 78.0)) AS BIGINT)), lambda k: substr(text, 74 + 78 * k, 78))), '|') AS lines FROM documents WHERE text IS NOT NULL""")
def texts_for_pages(t):
    """Escaped texts, texts in lines, and header parts around the first =."""
    name, value = M.header_parts(F.concat_ws("=", "source", "lang", F.lit("x")))
    rows = t("documents").where("text is not null")
    return rows.select("doc_id", M.escaped(F.col("text")).alias("escaped"), name.alias("name"), value.alias("value"), F.array_join(M.lines_of(F.col("text")), "|").alias("lines"))


@query("""SELECT c_custkey, list_sort(list_distinct(a || b)) AS added, len(list_filter(b, lambda x: NOT list_contains(a, x))) > 0 AS changed, len(list_filter(b, lambda x: NOT list_contains(a, x))) = 0 AS holds,
len(list_filter(b, lambda x: NOT list_contains(a, x))) = 0 AND len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 AS equal FROM (
SELECT c_custkey, ['s' || (c_custkey % 3), 's' || (c_nationkey % 3)] AS a, ['s' || (c_nationkey % 2), 's' || (c_custkey % 2)] AS b FROM customer)""")
def scope_sets(t):
    """Sets of access scopes: joined, contained, equal."""
    name = lambda c, k: F.concat(F.lit("s"), (F.col(c) % k).cast("string"))
    a, b = F.array(name("c_custkey", 3), name("c_nationkey", 3)), F.array(name("c_nationkey", 2), name("c_custkey", 2))
    added, changed = M.add_all(a, b)
    return t("customer").select("c_custkey", F.array_sort(added).alias("added"), changed.alias("changed"), M.contains_all(a, b).alias("holds"), M.equal_sets(a, b).alias("equal"))


@query("""WITH p AS (SELECT p_partkey, CAST(300 + p_partkey % 900 AS DOUBLE) AS bw, CAST(200 + p_size * 10 AS DOUBLE) AS bh, 100.0::DOUBLE AS head, CAST(40 + p_partkey % 77 AS DOUBLE) AS w, CAST(30 + p_partkey % 53 AS DOUBLE) AS h, CAST(p_partkey % 21 - 10 AS DOUBLE) AS par FROM part),
c AS (SELECT *, ceil(bw / 2) AS half, greatest(50, bh - head) AS top, least(ceil(bw / 2) - 2, 350) AS w0 FROM p),
d AS (SELECT *, CASE WHEN ceil(w0 * h / w) > top THEN ceil(top * w / h) ELSE w0 END AS cw, least(ceil(w0 * h / w), top) AS ch FROM c),
e AS (SELECT *, w * (1 - abs(par / w)) AS clipped FROM d), f AS (SELECT *, ceil(bw * h / clipped) AS wh0 FROM e),
g AS (SELECT *, CASE WHEN wh0 > bh THEN ceil(bh * clipped / h) ELSE bw END AS ww, least(wh0, bh) AS wh FROM f)
SELECT p_partkey, CAST(half - cw - 2 AS BIGINT) AS x, CAST(half + 2 AS BIGINT) AS right_x, CAST(greatest(head, floor((bh - ch) / 2)) AS BIGINT) AS y, CAST(cw AS BIGINT) AS width, CAST(ch AS BIGINT) AS height,
CAST(floor((bw - ww) / 2) AS BIGINT) AS wobble_x, CAST(ww AS BIGINT) AS wobble_width, CAST(wh AS BIGINT) AS wobble_height, CAST(CASE WHEN par >= 0 THEN floor(-(wh * w / h * (par / w))) ELSE 0 END AS BIGINT) AS shift0,
CASE WHEN par > 0 THEN CAST(greatest(14, ceil(greatest(0.0, least(1.0, w / par)) * 194)) AS INTEGER) END AS bar, greatest(80.0, least(bh / 4, 120.0)) AS strip, greatest(300, p_partkey - 300) AS delay FROM g""")
def layouts(t):
    """Where a viewer puts pictures, bars and strips."""
    key = F.col("p_partkey")
    bw, bh, w, h, par = (c.cast("double") for c in (300 + key % 900, 200 + F.col("p_size") * 10, 40 + key % 77, 30 + key % 53, key % 21 - 10))
    cross, right, wobble = M.cross_layout(bw, bh, F.lit(100.0), w, h, F.lit(False)), M.cross_layout(bw, bh, F.lit(100.0), w, h, F.lit(True)), M.wobble_layout(bw, bh, w, h, par)
    rows = t("part").select("p_partkey", cross.alias("c"), right["x"].alias("right_x"), wobble.alias("o"), M.progress_width(w, par, F.lit(0)).alias("bar"), M.strip_height(bh).alias("strip"), M.refresh_delay(key).alias("delay"))
    return rows.select("p_partkey", "c.*", "right_x", F.col("o.x").cast("long").alias("wobble_x"), F.col("o.width").alias("wobble_width"), F.col("o.height").alias("wobble_height"), F.col("o.shift0").cast("long").alias("shift0"), "bar", "strip", "delay")


@query("""SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) ON o_custkey = c_custkey AND r = 1""")
def first_matches(t):
    """The first row of a key, or none."""
    orders = t("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return A.first_match(t("customer").select("c_custkey"), orders, "c_custkey", "o_orderkey")


@query("""SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber) AS uid FROM lineitem""")
def unique_ids(t):
    """Dense numbers in a global order, from counts of range partitions."""
    return A.unique_ids(t("lineitem").select("l_shipdate", "l_orderkey", "l_linenumber"), ["l_shipdate", "l_orderkey", "l_linenumber"], "uid").drop("l_shipdate")


@query("""WITH p AS (SELECT l_orderkey AS album, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS pos, count(*) OVER (PARTITION BY l_orderkey) AS n, CASE WHEN l_partkey % 3 = 0 THEN 'PENDING' WHEN l_partkey % 7 = 0 THEN 'LOADING' ELSE 'LOADED' END AS state FROM lineitem),
s AS (SELECT *, ((pos - CASE WHEN album % 6 < n THEN album % 6 ELSE 0 END) % n + n) % n AS step FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY album ORDER BY step) AS k FROM s WHERE step < 4 AND state <> 'LOADED')
SELECT album, pos FROM r WHERE k = 1 AND state = 'PENDING'""")
def prefetched(t):
    """The photograph that is loaded next, seen from the current one."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")).cast("long") - 1
    state = F.when(F.col("l_partkey") % 3 == 0, "PENDING").when(F.col("l_partkey") % 7 == 0, "LOADING").otherwise("LOADED")
    photos = t("lineitem").select(F.col("l_orderkey").alias("album"), place.alias("pos"), state.alias("state"))
    return A.prefetch(photos, photos.select("album", (F.col("album") % 6).alias("pos")).distinct(), "album", "pos", "state")


@query("""WITH a AS (SELECT l_orderkey AS album, l_linenumber AS pos, l_partkey % 5 AS photo FROM lineitem), b AS (SELECT l_orderkey AS album, l_linenumber - 1 AS pos, l_partkey % 5 AS photo FROM lineitem WHERE l_linenumber > 1)
SELECT coalesce(a.album, b.album) AS album, coalesce(a.pos, b.pos) AS pos, CASE WHEN b.album IS NULL THEN 'remove' WHEN a.album IS NULL THEN 'insert' ELSE 'replace' END AS action, coalesce(b.photo, a.photo) AS photo
FROM a FULL JOIN b ON a.album = b.album AND a.pos = b.pos WHERE a.album IS NULL OR b.album IS NULL OR a.photo <> b.photo""")
def merged_lists(t):
    """What changes place by place when the first photograph of each album goes."""
    shown = t("lineitem").select(F.col("l_orderkey").alias("album"), F.col("l_linenumber").alias("pos"), (F.col("l_partkey") % 5).alias("photo"))
    return A.merged(shown, shown.where("pos > 1").withColumn("pos", F.col("pos") - 1), "album", "pos", "photo")


_LEVEL = "CAST(floor(least(greatest(CAST({} AS DOUBLE), -1), 1) * 127 + 128) AS INTEGER)"


def _level(x):
    return F.floor(F.least(F.greatest(x.cast("double"), F.lit(-1.0)), F.lit(1.0)) * 127 + 128).cast("int")


@query(f"""SELECT a.vec_id, CAST(round_even(a.g * 0.7::DOUBLE + a.b * 0.3::DOUBLE, 0) AS INTEGER) AS r, b.g, b.b, a.a FROM
(SELECT vec_id, {_LEVEL.format("embedding[2]")} AS g, {_LEVEL.format("embedding[3]")} AS b, {_LEVEL.format("embedding[4]")} AS a FROM embeddings) a JOIN
(SELECT vec_id, {_LEVEL.format("embedding[6]")} AS g, {_LEVEL.format("embedding[7]")} AS b FROM embeddings) b ON a.vec_id = b.vec_id""")
def anaglyph_pixels(t):
    """Two pictures' pixels as one for coloured glasses."""
    pixels = lambda k: t("embeddings").select("vec_id", *(_level(F.get("embedding", F.lit(k + i))).alias(c) for i, c in enumerate("rgba")))
    return A.anaglyphs(pixels(0), pixels(4), ["vec_id"])


_DIFF = "list_transform(embedding[1:16], lambda x: CAST(floor(CAST(x AS DOUBLE) * 200) AS BIGINT))"
_ROWS = """list_transform([0, 1, 2, 3], lambda i: [(d[4*i+1] + d[4*i+4]) * 8 + (d[4*i+2] + d[4*i+3]) * 8, ((d[4*i+2] - d[4*i+3]) * 8 * 2217 + (d[4*i+1] - d[4*i+4]) * 8 * 5352 + 14500) >> 12,
(d[4*i+1] + d[4*i+4]) * 8 - (d[4*i+2] + d[4*i+3]) * 8, ((d[4*i+1] - d[4*i+4]) * 8 * 2217 - (d[4*i+2] - d[4*i+3]) * 8 * 5352 + 7500) >> 12])"""
_COEFFICIENTS = f"""c AS (SELECT vec_id, flatten(list_transform([0, 1, 2, 3], lambda r: list_transform([1, 2, 3, 4], lambda i: CASE r
WHEN 0 THEN (t[1][i] + t[4][i] + t[2][i] + t[3][i] + 7) >> 4 WHEN 1 THEN (((t[2][i] - t[3][i]) * 2217 + (t[1][i] - t[4][i]) * 5352 + 12000) >> 16) + CASE WHEN t[1][i] <> t[4][i] THEN 1 ELSE 0 END
WHEN 2 THEN (t[1][i] + t[4][i] - t[2][i] - t[3][i] + 7) >> 4 ELSE ((t[1][i] - t[4][i]) * 2217 - (t[2][i] - t[3][i]) * 5352 + 51000) >> 16 END))) AS v
FROM (SELECT vec_id, {_ROWS} AS t FROM (SELECT vec_id, {_DIFF} AS d FROM embeddings)))"""


def _coefficients(t):
    diff = F.transform(F.slice("embedding", 1, 16), lambda x: F.floor(x.cast("double") * 200).cast("long"))
    return t("embeddings").select("vec_id", B.forward_transform(diff).alias("v"))


@query(f"""WITH {_COEFFICIENTS} SELECT vec_id, v AS coefficients FROM c""")
def block_transforms(t):
    """The coefficients of blocks of differences."""
    return _coefficients(t).withColumnRenamed("v", "coefficients")


@query(f"""WITH {_COEFFICIENTS},
q AS (SELECT vec_id, list_transform({B.ZIGZAG}, lambda j: CASE WHEN abs(v[j + 1]) + ((({B.SHARPENING})[j + 1] * CASE j WHEN 0 THEN 9 ELSE 12 END) >> 11) <= ((256 - 96) * CASE j WHEN 0 THEN 9 ELSE 12 END + 127) >> 8 THEN 0
ELSE sign(v[j + 1]) * least(2048, ((abs(v[j + 1]) + ((({B.SHARPENING})[j + 1] * CASE j WHEN 0 THEN 9 ELSE 12 END) >> 11)) * CASE j WHEN 0 THEN 14563 ELSE 10922 END + (96 << 9)) >> 17) END) AS levels FROM c)
SELECT vec_id, levels, CAST(coalesce(list_max(list_filter(range(16), lambda k: levels[k + 1] <> 0)), -1) AS INTEGER) AS last FROM q""")
def block_levels(t):
    """The quantised coefficients of blocks in coding order, and the last that is not 0."""
    levels = _coefficients(t).select("vec_id", B.quantised(F.col("v"), B.matrix(F.lit(9), F.lit(12), "luma")).alias("levels"))
    return levels.withColumn("last", B.last_level(F.col("levels")))


_ALPHAS = f"""{_COEFFICIENTS}, k AS (SELECT vec_id, least(abs(x) // 4, 64) AS k, count(*) AS n FROM (SELECT vec_id, unnest(v) AS x FROM c) GROUP BY 1, 2),
w AS (SELECT *, sum(CASE WHEN k > 0 THEN n ELSE 0 END) OVER (PARTITION BY vec_id ORDER BY k) AS run FROM k),
alphas AS (SELECT vec_id, greatest(0, least(255, CASE WHEN sum(k * k) > 0 THEN CAST(trunc(10 * CAST(sum(run * k) AS DOUBLE) / CAST(sum(k * k) AS DOUBLE) - 5) AS INTEGER) ELSE 0 END)) AS alpha FROM w GROUP BY vec_id)"""


def _alphas(t):
    return B.susceptibility(_coefficients(t).select("vec_id", F.explode("v").alias("x")), ["vec_id"], "x")


@query(f"""WITH {_ALPHAS} SELECT vec_id, alpha FROM alphas""")
def block_susceptibility(t):
    """How much each block's coefficients spread."""
    return _alphas(t)


@query(f"""WITH {_ALPHAS} SELECT label AS picture, CASE WHEN count(*) = 0 THEN 255 ELSE CAST(trunc((255 * count_if(alpha < 10) + count(*) / 2.0::DOUBLE) / count(*)) AS INTEGER) END AS below,
CAST(trunc((count(*) - count_if(alpha = 0)) * 255 / CAST(count(*) AS DOUBLE)) AS INTEGER) AS unskipped FROM alphas JOIN embeddings USING (vec_id) GROUP BY label""")
def picture_probabilities(t):
    """Probabilities that a picture's blocks give."""
    rows = _alphas(t).join(t("embeddings").select("vec_id", F.col("label").alias("picture")), "vec_id")
    low, n = F.count_if(F.col("alpha") < 10), F.count("*")
    return rows.groupBy("picture").agg(B.tree_probability(low, n - low).alias("below"), B.skip_probability(F.count_if(F.col("alpha") == 0), n).alias("unskipped"))


@query(f"""SELECT a.vec_id, a.label, b.level AS left_level, c.level AS top_level FROM (SELECT vec_id, label, vec_id % 16 AS x, vec_id // 16 AS y FROM embeddings) a
LEFT JOIN (SELECT vec_id % 16 AS x, vec_id // 16 AS y, {_LEVEL.format("embedding[1]")} AS level FROM embeddings) b ON b.x = a.x - 1 AND b.y = a.y LEFT JOIN (SELECT vec_id % 16 AS x, vec_id // 16 AS y, {_LEVEL.format("embedding[1]")} AS level FROM embeddings) c ON c.x = a.x AND c.y = a.y - 1""")
def block_neighbours(t):
    """Blocks with a value of the one on the left and the one above."""
    rows = t("embeddings").select("vec_id", "label", (F.col("vec_id") % 16).alias("x"), F.floor(F.col("vec_id") / 16).alias("y"), _level(F.get("embedding", F.lit(0))).alias("level"), F.lit(1).alias("picture"))
    return B.beside(rows, ["picture"], ["level"]).select("vec_id", "label", "left_level", "top_level")


@query(f"""SELECT vec_id // 256 AS picture, CAST((vec_id % 16) // 2 AS INTEGER) AS x, CAST(((vec_id // 16) % 16) // 2 AS INTEGER) AS y, CAST(sum({_LEVEL.format("embedding[1]")}) * 4 // count(*) AS INTEGER) AS r FROM embeddings GROUP BY 1, 2, 3""")
def half_samples(t):
    """Sums of 2 x 2 squares of pixels, weighted where the picture ends."""
    rows = t("embeddings").select(F.floor(F.col("vec_id") / 256).alias("picture"), (F.col("vec_id") % 16).alias("x"), (F.floor(F.col("vec_id") / 16) % 16).alias("y"), _level(F.get("embedding", F.lit(0))).alias("r"))
    return B.half_sampled(rows, ["picture"], ["r"])


@query("""WITH leaves AS (SELECT n_regionkey AS doc, n_nationkey AS trunk, c_custkey AS leaf, octet_length(encode(c_name)) AS size FROM customer JOIN nation ON c_nationkey = n_nationkey),
w AS (SELECT *, 1 + CASE WHEN size = 1 THEN 1 ELSE CAST(ceil(length(bin(size - 1)) / 8.0) AS INTEGER) + 1 END AS head FROM leaves),
trunks AS (SELECT doc, trunk, CAST(sum(size + head) AS BIGINT) AS size FROM w GROUP BY doc, trunk),
v AS (SELECT *, 2 + CASE WHEN size = 1 THEN 1 ELSE CAST(ceil(length(bin(size - 1)) / 8.0) AS INTEGER) + 1 END AS head FROM trunks),
every AS (SELECT doc, trunk, leaf, CAST(size AS BIGINT) AS size, CAST(head AS BIGINT) AS head, size AS own FROM w UNION ALL SELECT doc, trunk, -1, size, head, 0 FROM v)
SELECT doc, trunk, CASE WHEN leaf >= 0 THEN leaf END AS leaf, size, CAST(coalesce(sum(head + own) OVER (PARTITION BY doc ORDER BY trunk, leaf ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place FROM every""")
def tree_places(t):
    """Lengths and places of the nodes of element trees."""
    rows = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("doc"), "n_nationkey", "c_custkey", "c_name")
    none = F.lit(None).cast("array<int>")
    leaves = rows.select("doc", F.array("n_nationkey", F.col("c_custkey").cast("int")).alias("path"), F.lit(X.BLOCK).cast("long").alias("id"), F.encode("c_name", "UTF-8").alias("payload"), none.alias("target"), none.alias("origin"))
    trunks = rows.select("doc", F.array("n_nationkey").alias("path"), F.lit(X.SEEK).cast("long").alias("id"), F.lit(None).cast("binary").alias("payload"), none.alias("target"), none.alias("origin")).distinct()
    placed = X.laid_out(leaves.unionByName(trunks))
    return placed.select("doc", F.get("path", F.lit(0)).alias("trunk"), F.get("path", F.lit(1)).cast("long").alias("leaf"), "size", "place")


_PIXELS = "SELECT vec_id // 2 AS picture, CAST(vec_id % 2 AS INTEGER) AS eye, CAST(k % 8 AS INTEGER) AS x, CAST(k // 8 AS INTEGER) AS y, CAST(floor(least(greatest(CAST(embedding[k + 1] AS DOUBLE), -1), 1) * 127 + 128) AS INTEGER) AS r FROM embeddings, unnest(range(64)) AS u(k)"


@query(f"""WITH p AS ({_PIXELS}), s AS (SELECT picture, CAST(picture % 5 - 2 AS INTEGER) AS parallax, 8 - abs(picture % 5 - 2) AS clipped FROM p GROUP BY ALL),
f AS (SELECT *, CASE WHEN 6 * clipped // 8 > 5 THEN 5 ELSE 6 * clipped // 8 END AS w, CASE WHEN 6 * clipped // 8 > 5 THEN 5 * 6 // (6 * clipped // 8) ELSE 6 END AS h FROM s),
c AS (SELECT picture, eye, x - CASE WHEN parallax > 0 AND eye = 0 THEN parallax WHEN parallax < 0 AND eye = 1 THEN -parallax ELSE 0 END AS sx, y AS sy, r, clipped, w, h FROM p JOIN f USING (picture)),
a AS (SELECT picture, tx + eye * w AS x, ty AS y, r, (least((sx + 1) * w, (tx + 1) * clipped) - greatest(sx * w, tx * clipped)) * (least((sy + 1) * h, (ty + 1) * 8) - greatest(sy * h, ty * 8)) AS area, clipped * 8 AS whole
  FROM c, unnest(range(5)) AS u(tx), unnest(range(6)) AS v(ty) WHERE sx >= 0 AND sx < clipped AND tx < w AND ty < h AND (sx + 1) * w > tx * clipped AND sx * w < (tx + 1) * clipped AND (sy + 1) * h > ty * 8 AND sy * h < (ty + 1) * 8)
SELECT picture, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST((2 * sum(r * area) + any_value(whole)) // (2 * any_value(whole)) AS INTEGER) AS r FROM a GROUP BY picture, x, y""")
def side_by_side(t):
    """Two pictures of 8 x 8 pixels on one canvas, cut by their parallax and made at most 5 x 6 pixels each."""
    pixels = t("embeddings").select(F.floor(F.col("vec_id") / 2).alias("picture"), (F.col("vec_id") % 2).cast("int").alias("eye"), F.posexplode(F.transform("embedding", lambda e: _level(e))).alias("k", "r"))
    pixels = pixels.select("picture", "eye", (F.col("k") % 8).alias("x"), F.floor(F.col("k") / 8).cast("int").alias("y"), "r")
    pictures = t("embeddings").select(F.floor(F.col("vec_id") / 2).alias("picture")).distinct().select("picture", F.lit(8).alias("width"), F.lit(8).alias("height"), (F.col("picture") % 5 - 2).cast("int").alias("parallax"))
    return P.side_by_side(pixels, pictures, "picture", ["r"], max_width=5, max_height=6)


@query("""WITH h AS (SELECT 'n' || s_nationkey AS source, min(s_suppkey) AS album FROM supplier WHERE s_suppkey % 3 = 0 GROUP BY s_nationkey),
a AS (SELECT DISTINCT 'n' || c_nationkey AS source FROM customer WHERE c_custkey % 10 <> 0 EXCEPT SELECT source FROM h)
SELECT source, album FROM h UNION ALL SELECT source, (SELECT max(album) FROM h) + row_number() OVER (ORDER BY source) FROM a""")
def albums_of_sources(t):
    """Albums of sources that are asked for, each made once where there is none."""
    have = t("supplier").where("s_suppkey % 3 = 0").groupBy(F.concat(F.lit("n"), "s_nationkey").alias("source")).agg(F.min("s_suppkey").alias("album"))
    asked = t("customer").select(F.when(F.col("c_custkey") % 10 != 0, F.concat(F.lit("n"), "c_nationkey")).alias("source"))
    return A.source_albums(have, asked, "source", "album")
