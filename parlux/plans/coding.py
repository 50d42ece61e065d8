"""Queries over blocks of pictures (scaled embeddings are blocks): segments by clustering, quantisers of segments, what transforms lose, means of
blocks, and prediction modes; each with its SQL, which works on lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlux.operators import blocks as B
from parlux.operators import tokens as K
from parlux.operators.shared import kept, small_or_shuffled
from parlux.plans import media as P
from parlux.plans.reference import ORACLE_SQL, query

_COLUMNS = P._COEFFICIENTS.split("SELECT vec_id, ", 1)[1].split(" AS v\nFROM", 1)[0]


def _coefficients_sql(source: str, keys: str) -> str:
    """SQL of (keys, v) from (keys, d: 16 differences)."""
    return f"SELECT {keys}, {_COLUMNS} AS v FROM (SELECT {keys}, {P._ROWS} AS t FROM {source})"


def _differences(t, first: int):
    return F.transform(F.slice("embedding", first, 16), lambda x: F.floor(x.cast("double") * 200).cast("long"))


def _differences_sql(first: int) -> str:
    return f"list_transform(embedding[{first} : {first + 15}], lambda x: CAST(floor(CAST(x AS DOUBLE) * 200) AS BIGINT))"


# segments


_PLACE = "CASE WHEN NOT (2 * {a} > {c}[1] + {c}[2] AND {c}[2] > {c}[1]) THEN 0 WHEN NOT (2 * {a} > {c}[2] + {c}[3] AND {c}[3] > {c}[2]) THEN 1 WHEN NOT (2 * {a} > {c}[3] + {c}[4] AND {c}[4] > {c}[3]) THEN 2 ELSE 3 END"


def _segments_sql() -> str:
    """A chain of tables: counts, first centres, and six rounds that change nothing once a picture is still."""
    out = f"""{P._ALPHAS}, n AS MATERIALIZED (SELECT label AS picture, alpha AS a, count(*) AS n FROM alphas JOIN embeddings USING (vec_id) GROUP BY ALL),
c0 AS MATERIALIZED (SELECT picture, list_transform(range(4), lambda k: low + (2 * k + 1) * (high - low) // 8) AS c, CAST(NULL AS BIGINT[]) AS used, CAST(0 AS BIGINT) AS mean, false AS still
  FROM (SELECT picture, CAST(min(a) AS BIGINT) AS low, CAST(max(a) AS BIGINT) AS high FROM n GROUP BY picture))"""
    for r in range(6):
        fresh = ", ".join(f"CASE WHEN w{k} > 0 THEN (2 * t{k} + w{k}) // (2 * w{k}) ELSE c[{k + 1}] END" for k in range(4))
        sums = ", ".join(f"CAST(coalesce(sum(a * n) FILTER (s = {k}), 0) AS BIGINT) AS t{k}, CAST(coalesce(sum(n) FILTER (s = {k}), 0) AS BIGINT) AS w{k}" for k in range(4))
        out += f""",
f{r} AS MATERIALIZED (SELECT *, [{fresh}] AS f FROM (SELECT picture, c, used, mean, still, {sums} FROM (SELECT n.*, c, used, mean, still, {_PLACE.format(a='a', c='c')} AS s FROM n JOIN c{r} USING (picture)) GROUP BY picture, c, used, mean, still)),
c{r + 1} AS MATERIALIZED (SELECT picture, CASE WHEN still THEN c ELSE f END AS c, CASE WHEN still THEN used ELSE c END AS used,
  CASE WHEN still THEN mean ELSE (2 * (f[1] * w0 + f[2] * w1 + f[3] * w2 + f[4] * w3) + w0 + w1 + w2 + w3) // (2 * (w0 + w1 + w2 + w3)) END AS mean,
  still OR abs(f[1] - c[1]) + abs(f[2] - c[2]) + abs(f[3] - c[3]) + abs(f[4] - c[4]) < 5 AS still FROM f{r})"""
    return out + f""",
segments AS MATERIALIZED (SELECT picture, a AS alpha, CAST(s AS INTEGER) AS segment, CAST(c[s + 1] AS INTEGER) AS centre, CAST(mean AS INTEGER) AS mean, CAST(list_min(c) AS INTEGER) AS low, CAST(list_max(c) AS INTEGER) AS high
  FROM (SELECT n.*, c, mean, {_PLACE.format(a='a', c='used')} AS s FROM n JOIN c6 USING (picture)))"""


_SEGMENTS = _segments_sql()


def _segments(t):
    return B.segments(P._alphas(t).join(t("embeddings").select("vec_id", F.col("label").alias("picture")), "vec_id"), "picture", "alpha")


@query(f"WITH {_SEGMENTS} SELECT * FROM segments")
def block_segments(t):
    """The segments of each picture's susceptibilities, by rounds of clustering over its counts."""
    return _segments(t)


@query(f"""WITH {_SEGMENTS}, b AS (SELECT label AS picture, segment FROM embeddings JOIN alphas USING (vec_id) JOIN segments ON segments.picture = label AND segments.alpha = alphas.alpha),
counted AS (SELECT picture, count_if(segment = 0) AS n0, count_if(segment = 1) AS n1, count_if(segment = 2) AS n2, count_if(segment = 3) AS n3 FROM b GROUP BY picture)
SELECT picture, CASE WHEN n0 + n1 + n2 + n3 = 0 THEN 255 ELSE (2 * 255 * (n0 + n1) + n0 + n1 + n2 + n3) // (2 * (n0 + n1 + n2 + n3)) END AS p0,
CASE WHEN n0 + n1 = 0 THEN 255 ELSE (2 * 255 * n0 + n0 + n1) // (2 * (n0 + n1)) END AS p1, CASE WHEN n2 + n3 = 0 THEN 255 ELSE (2 * 255 * n2 + n2 + n3) // (2 * (n2 + n3)) END AS p2 FROM counted""")
def segment_trees(t):
    """The probabilities of the tree over each picture's segments."""
    blocks = P._alphas(t).join(t("embeddings").select("vec_id", F.col("label").alias("picture")), "vec_id").join(_segments(t).select("picture", "alpha", "segment"), ["picture", "alpha"])
    rows = B.segment_probabilities(blocks, "picture", "segment")
    return rows.select("picture", *(F.col(p).cast("long").alias(p) for p in ("p0", "p1", "p2")))


_QUALITY, _STRENGTH = 80, 60


def _chroma_alphas(t):
    rows = t("embeddings").select(F.col("label").alias("picture"), "vec_id", F.explode(B.forward_transform(_differences(t, 17))).alias("x"))
    return B.susceptibility(rows, ["picture", "vec_id"], "x")


def _matrices(t, segments):
    return B.segment_matrices(segments, B.chroma_mean(_chroma_alphas(t), "picture", "alpha"), "picture", _QUALITY, _STRENGTH)


_STEPS = f"""{_SEGMENTS}, u AS ({_coefficients_sql(f"(SELECT label AS picture, vec_id, {_differences_sql(17)} AS d FROM embeddings)", "picture, vec_id")}),
uk AS (SELECT picture, vec_id, least(abs(x) // 4, 64) AS k, count(*) AS n FROM (SELECT picture, vec_id, unnest(v) AS x FROM u) GROUP BY ALL),
uw AS (SELECT *, sum(CASE WHEN k > 0 THEN n ELSE 0 END) OVER (PARTITION BY vec_id, picture ORDER BY k) AS run FROM uk),
ua AS (SELECT picture, vec_id, greatest(0, least(255, CASE WHEN sum(k * k) > 0 THEN CAST(trunc(10 * CAST(sum(run * k) AS DOUBLE) / CAST(sum(k * k) AS DOUBLE) - 5) AS INTEGER) ELSE 0 END)) AS alpha FROM uw GROUP BY picture, vec_id),
h AS (SELECT picture, CAST(sum(alpha) // count(*) AS INTEGER) AS chroma FROM ua GROUP BY picture),
g AS (SELECT DISTINCT picture, segment, greatest(-127, least(127, CAST(trunc(255 * CAST(centre - mean AS DOUBLE) / CASE WHEN high = low THEN 1 ELSE high - low END) AS INTEGER))) AS alpha,
  greatest(0, least(255, CAST(trunc(255 * CAST(centre - low AS DOUBLE) / CASE WHEN high = low THEN 1 ELSE high - low END) AS INTEGER))) AS beta, chroma FROM segments JOIN h USING (picture)),
q AS (SELECT *, greatest(0, least(127, CAST(trunc(127.0::DOUBLE * (1.0::DOUBLE - pow(2.0::DOUBLE * 0.8::DOUBLE - 1.0::DOUBLE, (1.0::DOUBLE - 0.9::DOUBLE * {_STRENGTH} / 100.0::DOUBLE / 128.0::DOUBLE * alpha) / 3.0::DOUBLE))) AS INTEGER))) AS quantiser,
  greatest(-4, least(6, CAST(trunc(CAST(trunc(CAST((chroma - 64) * 10 AS DOUBLE) / 70) AS INTEGER) * {_STRENGTH} / 100.0::DOUBLE) AS INTEGER))) AS uv_ac, CAST(trunc(-4 * {_STRENGTH} / 100.0::DOUBLE) AS INTEGER) AS uv_dc FROM g),
steps AS (SELECT picture, segment, alpha, beta, quantiser, ({B.DC_STEPS})[quantiser + 1] AS dc, ({B.AC_STEPS})[quantiser + 1] AS ac, greatest(8, ({B.AC_STEPS})[quantiser + 1] * 155 // 100) AS mean_ac,
  ({B.DC_STEPS})[greatest(0, least(117, quantiser + uv_dc)) + 1] AS chroma_dc, ({B.AC_STEPS})[greatest(0, least(127, quantiser + uv_ac)) + 1] AS chroma_ac FROM q)"""


@query(f"""WITH {_STEPS} SELECT picture, segment, alpha, beta, quantiser, CAST((dc + 15 * ac + 8) >> 4 AS BIGINT) AS luma, CAST((2 * dc + 15 * mean_ac + 8) >> 4 AS BIGINT) AS means, CAST((chroma_dc + 15 * chroma_ac + 8) >> 4 AS BIGINT) AS chroma FROM steps""")
def segment_steps(t):
    """The quantiser of each picture's segments, and the mean steps of its three matrices."""
    return _matrices(t, kept(_segments(t))).select("picture", "segment", "alpha", "beta", "quantiser", F.col("luma.mean").alias("luma"), F.col("mean_matrix.mean").alias("means"), F.col("chroma_matrix.mean").alias("chroma"))


@query(f"""WITH {_STEPS}, b AS (SELECT vec_id, v, dc, ac FROM c JOIN alphas USING (vec_id) JOIN embeddings USING (vec_id) JOIN segments ON segments.picture = label AND segments.alpha = alphas.alpha JOIN steps ON steps.picture = label AND steps.segment = segments.segment),
l AS (SELECT vec_id, dc, ac, list_transform({B.ZIGZAG}, lambda j: CASE WHEN abs(v[j + 1]) + ((({B.SHARPENING})[j + 1] * CASE j WHEN 0 THEN dc ELSE ac END) >> 11) <= ((256 - 96) * CASE j WHEN 0 THEN dc ELSE ac END + 127) >> 8 THEN 0
ELSE sign(v[j + 1]) * least(2048, ((abs(v[j + 1]) + ((({B.SHARPENING})[j + 1] * CASE j WHEN 0 THEN dc ELSE ac END) >> 11)) * (131072 // CASE j WHEN 0 THEN dc ELSE ac END) + (96 << 9)) >> 17) END) AS levels FROM b)
SELECT vec_id, list_transform(levels, lambda x: CAST(x AS BIGINT)) AS levels FROM l""")
def segment_levels(t):
    """The levels of blocks by the quantisers of their segments."""
    blocks = P._coefficients(t).join(P._alphas(t), "vec_id").join(t("embeddings").select("vec_id", F.col("label").alias("picture")), "vec_id")
    segments = kept(_segments(t))
    matrices = small_or_shuffled(kept(_matrices(t, segments).select("picture", "segment", "luma")))
    rows = blocks.join(small_or_shuffled(segments).select("picture", "alpha", "segment"), ["picture", "alpha"]).join(matrices, ["picture", "segment"])
    return rows.select("vec_id", B.quantised(F.col("v"), F.col("luma")).alias("levels"))


# transforms


def _inverse_sql(v: str) -> str:
    """SQL of the 16 differences of a list of 16 coefficients."""
    part = lambda x, f: f"(({x}) * {f} >> 16)"
    small, large = B.INVERSE
    one = lambda x, r="": f"[{x[0]}{r} + {x[2]} + ({part(x[1], large)} + {part(x[3], small)}), {x[0]}{r} - {x[2]} + ({part(x[1], small)} - {part(x[3], large)}), {x[0]}{r} - {x[2]} - ({part(x[1], small)} - {part(x[3], large)}), {x[0]}{r} + {x[2]} - ({part(x[1], large)} + {part(x[3], small)})]"
    columns = f"list_transform([1, 2, 3, 4], lambda i: {one([f'{v}[i]', f'{v}[i + 4]', f'{v}[i + 8]', f'{v}[i + 12]'])})"
    return f"flatten(list_transform([1, 2, 3, 4], lambda i: list_transform({one(['w[1][i]', 'w[2][i]', 'w[3][i]', 'w[4][i]'], ' + 4')}, lambda x: x >> 3)))", columns


_LAST, _FIRST = _inverse_sql("q")


@query(f"""WITH {P._COEFFICIENTS}, d AS (SELECT vec_id, {P._DIFF} AS d FROM embeddings),
l AS (SELECT vec_id, list_transform(range(16), lambda j: CASE WHEN abs(v[j + 1]) + ((({B.SHARPENING})[j + 1] * CASE j WHEN 0 THEN 9 ELSE 12 END) >> 11) <= ((256 - 96) * CASE j WHEN 0 THEN 9 ELSE 12 END + 127) >> 8 THEN 0
ELSE CAST(sign(v[j + 1]) AS BIGINT) * least(2048, ((abs(v[j + 1]) + ((({B.SHARPENING})[j + 1] * CASE j WHEN 0 THEN 9 ELSE 12 END) >> 11)) * CASE j WHEN 0 THEN 14563 ELSE 10922 END + (96 << 9)) >> 17) * CASE j WHEN 0 THEN 9 ELSE 12 END END) AS q FROM c),
r AS (SELECT vec_id, {_LAST} AS restored FROM (SELECT vec_id, {_FIRST} AS w FROM l))
SELECT vec_id, restored, CAST(list_sum(list_transform(list_zip(d, restored), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS lost FROM r JOIN d USING (vec_id)""")
def block_losses(t):
    """What is left of blocks that are transformed, quantised and restored, and the squared error."""
    m = B.matrix(F.lit(9), F.lit(12), "luma")
    rows = t("embeddings").select("vec_id", _differences(t, 1).alias("d"))
    rows = rows.withColumn("levels", B.quantised(B.forward_transform(F.col("d")), m)).withColumn("restored", B.inverse_transform(B.restored(F.col("levels"), m)))
    return rows.select("vec_id", "restored", B.distortion(F.col("d"), F.col("restored")).alias("lost"))


@query(f"""WITH m AS (SELECT vec_id, {_differences_sql(33)} AS m FROM embeddings),
r AS (SELECT vec_id, list_transform(range(4), lambda i: [(m[4*i+1] + m[4*i+3]) * 4 + (m[4*i+2] + m[4*i+4]) * 4 + CASE WHEN m[4*i+1] + m[4*i+3] <> 0 THEN 1 ELSE 0 END, (m[4*i+1] - m[4*i+3]) * 4 + (m[4*i+2] - m[4*i+4]) * 4,
  (m[4*i+1] - m[4*i+3]) * 4 - (m[4*i+2] - m[4*i+4]) * 4, (m[4*i+1] + m[4*i+3]) * 4 - (m[4*i+2] + m[4*i+4]) * 4]) AS t FROM m),
b AS (SELECT vec_id, list_transform([1, 2, 3, 4], lambda i: [t[1][i] + t[3][i] + t[2][i] + t[4][i], t[1][i] - t[3][i] + t[2][i] - t[4][i], t[1][i] - t[3][i] - t[2][i] + t[4][i], t[1][i] + t[3][i] - t[2][i] - t[4][i]]) AS b FROM r),
c AS (SELECT vec_id, list_transform(range(16), lambda k: (b[k % 4 + 1][k // 4 + 1] + CASE WHEN b[k % 4 + 1][k // 4 + 1] > 0 THEN 1 ELSE 0 END + 3) >> 3) AS c FROM b),
w AS (SELECT vec_id, c, list_transform([1, 2, 3, 4], lambda i: [c[i] + c[i+12] + c[i+4] + c[i+8], c[i] - c[i+12] + c[i+4] - c[i+8], c[i] + c[i+12] - c[i+4] - c[i+8], c[i] - c[i+12] - c[i+4] + c[i+8]]) AS w FROM c)
SELECT vec_id, c AS coefficients, flatten(list_transform([1, 2, 3, 4], lambda r: list_transform([w[1][r] + 3 + w[4][r] + w[2][r] + w[3][r], w[1][r] + 3 - w[4][r] + w[2][r] - w[3][r], w[1][r] + 3 + w[4][r] - w[2][r] - w[3][r], w[1][r] + 3 - w[4][r] - w[2][r] + w[3][r]], lambda x: x >> 3))) AS means FROM w""")
def mean_transforms(t):
    """The coefficients of the means of a picture's blocks, and the means that they stand for."""
    rows = t("embeddings").select("vec_id", B.mean_transform(_differences(t, 33)).alias("coefficients"))
    return rows.select("vec_id", "coefficients", B.inverse_mean_transform(F.col("coefficients")).alias("means"))


# predictions


_SAMPLES = "SELECT vec_id // 64 AS picture, CAST(vec_id % 8 AS INTEGER) AS x, CAST((vec_id // 8) % 8 AS INTEGER) AS y, list_transform(embedding, lambda e: CAST(floor(least(greatest(CAST(e AS DOUBLE), -1), 1) * 127 + 128) AS BIGINT)) AS v FROM embeddings"


def _samples(t):
    key = F.col("vec_id")
    return t("embeddings").select(F.floor(key / 64).alias("picture"), (key % 8).cast("int").alias("x"), (F.floor(key / 8) % 8).cast("int").alias("y"), F.transform("embedding", lambda e: P._level(e)).alias("v"))


_SCORES = f"""b AS MATERIALIZED ({_SAMPLES}),
e AS (SELECT b.*, l.v AS lv, t.v AS tv, o.v AS ov FROM b LEFT JOIN b AS l ON l.picture = b.picture AND l.x = b.x - 1 AND l.y = b.y LEFT JOIN b AS t ON t.picture = b.picture AND t.x = b.x AND t.y = b.y - 1 LEFT JOIN b AS o ON o.picture = b.picture AND o.x = b.x - 1 AND o.y = b.y - 1),
s AS (SELECT picture, x, y, v, CASE WHEN lv IS NOT NULL THEN list_transform(range(8), lambda j: lv[8 * j + 8]) END AS l, tv[57:64] AS t, ov[64] AS o FROM e),
p AS (SELECT picture, x, y, m AS mode, list_transform(range(64), lambda k: v[k + 1] - CASE m
  WHEN 0 THEN CASE WHEN l IS NULL AND t IS NULL THEN 128 WHEN l IS NULL THEN CAST(2 * list_sum(t) + 8 AS BIGINT) >> 4 WHEN t IS NULL THEN CAST(2 * list_sum(l) + 8 AS BIGINT) >> 4 ELSE CAST(list_sum(l) + list_sum(t) + 8 AS BIGINT) >> 4 END
  WHEN 1 THEN CASE WHEN l IS NULL AND t IS NULL THEN 129 WHEN l IS NULL THEN t[k % 8 + 1] WHEN t IS NULL THEN l[k // 8 + 1] ELSE greatest(0, least(255, l[k // 8 + 1] + t[k % 8 + 1] - o)) END
  WHEN 2 THEN coalesce(t[k % 8 + 1], 127) ELSE coalesce(l[k // 8 + 1], 129) END) AS d FROM s, unnest(range(4)) AS u(m)),
f AS (SELECT picture, x, y, mode, q, list_transform(range(16), lambda k: d[((q // 2) * 4 + k // 4) * 8 + (q % 2) * 4 + k % 4 + 1]) AS d FROM p, unnest(range(4)) AS u(q)),
c AS ({_coefficients_sql("f", "picture, x, y, mode, q")}),
k AS (SELECT picture, x, y, mode, least(abs(z) // 4, 64) AS k, count(*) AS n FROM (SELECT picture, x, y, mode, unnest(v) AS z FROM c) GROUP BY ALL),
w AS (SELECT *, sum(CASE WHEN k > 0 THEN n ELSE 0 END) OVER (PARTITION BY picture, x, y, mode ORDER BY k) AS run FROM k),
scores AS (SELECT picture, x, y, CAST(mode AS INTEGER) AS mode, greatest(0, least(255, CASE WHEN sum(k * k) > 0 THEN CAST(trunc(10 * CAST(sum(run * k) AS DOUBLE) / CAST(sum(k * k) AS DOUBLE) - 5) AS INTEGER) ELSE 0 END)) AS score FROM w GROUP BY ALL)"""


@query(f"WITH {_SCORES} SELECT picture, x, y, mode, score FROM scores")
def mode_scores(t):
    """How much is left to be coded of each block behind each prediction."""
    return B.mode_scores(_samples(t), ["picture"], 8, "v")


@query(f"WITH {_SCORES} SELECT picture, x, y, mode, score FROM (SELECT *, row_number() OVER (PARTITION BY picture, x, y ORDER BY score DESC, mode) AS r FROM scores) WHERE r = 1")
def best_modes(t):
    """The mode of each block with the highest score, the first of equal ones."""
    return B.best_mode(B.mode_scores(_samples(t), ["picture"], 8, "v"), ["picture", "x", "y"])


# tokens


_LEVELS = ORACLE_SQL["block_levels"].split("SELECT vec_id, levels, CAST", 1)[0].removeprefix("WITH ")
_DECISIONS = f"""{_LEVELS},
g AS MATERIALIZED (SELECT vec_id // 256 AS picture, vec_id % 16 AS x, (vec_id // 16) % 16 AS y, list_transform(levels, lambda z: abs(CAST(z AS BIGINT))) AS v, coalesce(list_max(list_filter(range(16), lambda k: levels[k + 1] <> 0)), -1) AS last FROM q),
h AS (SELECT g.*, CASE WHEN l.last >= 0 THEN 1 ELSE 0 END + CASE WHEN t.last >= 0 THEN 1 ELSE 0 END AS c FROM g LEFT JOIN g AS l ON l.picture = g.picture AND l.x = g.x - 1 AND l.y = g.y LEFT JOIN g AS t ON t.picture = g.picture AND t.x = g.x AND t.y = g.y - 1),
n AS (SELECT picture, n, v[n + 1] AS size, CASE WHEN n > 0 THEN v[n] END AS before, CASE WHEN n > 0 THEN least(v[n], 2) ELSE c END AS context FROM h, unnest(range(last + 1)) AS u(n)),
d AS (
  SELECT picture, n, context, 0 AS place, 1 AS bit FROM n WHERE before IS NULL OR before > 0
  UNION ALL SELECT picture, n, context, 1, CAST(size > 0 AS INTEGER) FROM n
  UNION ALL SELECT picture, n, context, 2, CAST(size > 1 AS INTEGER) FROM n WHERE size > 0
  UNION ALL SELECT picture, n, context, 3, CAST(size > 4 AS INTEGER) FROM n WHERE size > 1
  UNION ALL SELECT picture, n, context, 4, CAST(size > 2 AS INTEGER) FROM n WHERE size BETWEEN 2 AND 4
  UNION ALL SELECT picture, n, context, 5, CAST(size > 3 AS INTEGER) FROM n WHERE size BETWEEN 3 AND 4
  UNION ALL SELECT picture, n, context, 6, CAST(size > 10 AS INTEGER) FROM n WHERE size > 4
  UNION ALL SELECT picture, n, context, 7, CAST(size > 6 AS INTEGER) FROM n WHERE size BETWEEN 5 AND 10
  UNION ALL SELECT picture, n, context, 8, CAST(size > 34 AS INTEGER) FROM n WHERE size > 10
  UNION ALL SELECT picture, n, context, 9, CAST(size > 18 AS INTEGER) FROM n WHERE size BETWEEN 11 AND 34
  UNION ALL SELECT picture, n, context, 10, CAST(size > 66 AS INTEGER) FROM n WHERE size > 34
  UNION ALL SELECT picture, last + 1, CASE WHEN last >= 0 THEN least(v[last + 1], 2) ELSE c END, 0, 0 FROM h WHERE last < 15),
counts AS (SELECT picture, ({K.BANDS})[n + 1] AS band, CAST(context AS INTEGER) AS context, CAST(place AS INTEGER) AS place, CAST(sum(bit) AS BIGINT) AS ones, count(*) AS total FROM d GROUP BY ALL)"""


def _counts(t):
    key = F.col("vec_id")
    levels = P._coefficients(t).select(F.floor(key / 256).alias("picture"), (key % 16).alias("x"), (F.floor(key / 16) % 16).alias("y"), B.quantised(F.col("v"), B.matrix(F.lit(9), F.lit(12), "luma")).alias("levels"))
    return K.token_counts(K.decisions(K.contexts(levels, ["picture"], "levels"), ["picture"], "levels", "context"), ["picture"])


@query(f"WITH {_DECISIONS} SELECT * FROM counts")
def block_tokens(t):
    """How often each decision about pictures' levels is a yes, by band, context and place in the tree."""
    return _counts(t)


_COST = "CAST(round(-256 * log2(greatest({}, 1) / 256.0::DOUBLE)) AS BIGINT)"
_BRANCH = "(ones * {one} + (total - ones) * {zero})"


def _branch(p: str) -> str:
    return _BRANCH.format(one=_COST.format(f"255 - {p}"), zero=_COST.format(p))


@query(f"""WITH {_DECISIONS}, o AS (SELECT DISTINCT picture, band, context, place, CAST(40 + 5 * band + 30 * context + 7 * place AS INTEGER) AS old, CAST(255 - 3 * band - place AS INTEGER) AS update FROM counts),
f AS (SELECT *, CASE WHEN ones > 0 THEN CAST(255 - ones * 255 // total AS INTEGER) ELSE 255 END AS fitted FROM counts JOIN o USING (picture, band, context, place)),
r AS (SELECT *, {_branch('old')} + {_COST.format('update')} - {_branch('fitted')} - {_COST.format('255 - update')} - 2048 > 0 AS renewed FROM f)
SELECT picture, band, context, place, ones, total, fitted, renewed, CASE WHEN renewed THEN fitted ELSE old END AS probability FROM r""")
def token_probabilities(t):
    """Which decisions get a new probability, as it saves more than it costs to write."""
    counts = kept(_counts(t))
    keys = ["picture", "band", "context", "place"]
    old, update = 40 + 5 * F.col("band") + 30 * F.col("context") + 7 * F.col("place"), 255 - 3 * F.col("band") - F.col("place")
    return K.chosen_probabilities(counts, counts.select(*keys, old.cast("int").alias("old"), update.cast("int").alias("update")), keys)
