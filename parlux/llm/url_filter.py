"""URL filters with redirect equivalence.

A url's own verdict is that of the longest rule that fits it. Urls that redirect to each other or name one canonical address are one
resource: connected components over these edges are found without gathering them, and a url without a rule of its own is blocked if
any url of its component is. A rule that fits the url itself, allow or block, goes before what it inherits.

Edges: for each page its canonical links (link rel=canonical) and its redirects (meta http-equiv=refresh), all of them, relative ones
taken from the page's url (dot segments resolved; other schemes such as mailto: are no edges); further redirects can be given as a
table (from_url, to_url). Nodes are urls without scheme and fragment, host lower-cased.

Defined results: a null url or one without :// has empty host and path, fits no rule and has no edges: allowed; null html gives no
edge; a null page_id is carried through; repeated rows are judged alike; an empty table gives no rows. Rules of equal length that fit:
allow goes first."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlux.llm._durable import connected, durable, renamed, small_or_shuffled

#: Fixed values of the production filter: (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: So many rules are tested in the row; more are joined by host.
IN_ROW = 64

_CANONICAL = r"""(?i)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
_HREF = r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
_TARGET = r"""(?i)\burl\s*=\s*["']?([^"'\s>;]+)"""


def _rest(url: Column) -> Column:
    """What follows the first ://, or an empty string."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)


def path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def address(url: Column) -> Column:
    """The node of a url: host, path and query; null without a host."""
    return F.when(host(url) != "", F.concat(host(url), F.regexp_extract(_rest(url), r"^[^/?#]*([^#]*)", 1)))


def _target(base: Column, href: Column) -> Column:
    """The node that a link on a page leads to."""
    href = F.replace(href, F.lit("&amp;"), F.lit("&"))
    here = F.concat(F.lit("http://"), host(base))
    way, query = F.regexp_extract(href, r"^([^?#]*)", 1), F.regexp_extract(href, r"^[^?#]*([^#]*)", 1)
    whole = F.when(F.instr(href, "://") > 0, href).when(F.startswith(href, F.lit("//")), F.concat(F.lit("http:"), href)).when(F.startswith(href, F.lit("/")), F.concat(here, _undotted(way), query))
    whole = whole.when(href.rlike("^([A-Za-z][A-Za-z0-9+.-]*:|#)"), F.lit(None)).when(F.startswith(href, F.lit("?")), F.concat(here, path(base), query))
    return address(whole.otherwise(F.concat(here, _undotted(F.concat(F.lit("/"), F.regexp_extract(path(base), "^/?(.*/)?[^/]*$", 1), way)), query)))


def _undotted(way: Column) -> Column:
    """A path that starts with /, its segments . and .. resolved."""
    steps = F.split(F.regexp_replace(way, r"/(\.\.?)$", "/$1/"), "/")
    step = lambda done, x: F.when(x == "..", F.regexp_replace(done, "/[^/]*$", "")).when(x == ".", done).otherwise(F.concat(done, F.lit("/"), x))
    return F.aggregate(F.slice(steps, 2, F.size(steps)), F.lit(""), step)


def page_edges(url: Column, html: Column) -> Column:
    """The nodes that a page's canonical links and redirects lead to (an array, perhaps empty)."""
    tags = lambda tag, part: F.transform(F.regexp_extract_all(html, F.lit(tag), F.lit(0)), lambda t: F.regexp_extract(t, part, 1))
    found = F.concat(tags(_CANONICAL, _HREF), tags(_REFRESH, _TARGET))
    return F.filter(F.transform(found, lambda h: F.when(h != "", _target(url, h))), lambda t: t.isNotNull() & (t != address(url)))


def _fits(h: Column, p: Column, rule_host: Column, rule_path: Column) -> Column:
    return ((h == rule_host) | F.endswith(h, F.concat(F.lit("."), rule_host))) & F.startswith(p, rule_path)


def _best(length: Column, rule: Column, verdict: Column) -> Column:
    return F.struct(length.alias("length"), (verdict == "allow").alias("allowed"), rule.alias("rule"))


def with_rule(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """urls (host, path and other columns) with rule, the longest that fits (null if none), and allowed."""
    if len(rules) <= IN_ROW:
        tried = [F.when(_fits(F.col("host"), F.col("path"), F.lit(h), F.lit(p)), _best(F.lit(len(h + p)), F.lit(h + p), F.lit(v))) for v, h, p in rules]
        best = F.array_max(F.array(*tried)) if tried else F.lit(None).cast("struct<length:int,allowed:boolean,rule:string>")
        return urls.withColumn("_best", best).select(*urls.columns, "_best.rule", "_best.allowed")
    table = urls.sparkSession.createDataFrame(rules, "verdict string, rule_host string, rule_path string")
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    tried = urls.select("host", "path").distinct().withColumn("rule_host", F.explode(ends)).join(small_or_shuffled(table), "rule_host").where(F.startswith("path", "rule_path"))
    text = F.concat("rule_host", "rule_path")
    best = tried.groupBy("host", "path").agg(F.max(_best(F.length(text), text, F.col("verdict"))).alias("_best"))
    return urls.join(best, ["host", "path"], "left").select(*urls.columns, "_best.rule", "_best.allowed")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], redirects: DataFrame | None = None) -> DataFrame:
    """One row for each row of pages (page_id, url, html): page_id, host, path, rule, verdict, inherited (by its component)."""
    rows, at, _ = renamed(pages)
    url, html = F.col(at["url"]).cast("string"), F.col(at["html"]).cast("string")
    given = rows.select(address(url).alias("a"), F.explode(page_edges(url, html)).alias("b"))
    if redirects is not None:
        given = given.unionByName(redirects.select(address(F.col("from_url")).alias("a"), address(F.col("to_url")).alias("b")))
    edges = durable(given.where("a is not null and b is not null").distinct())
    own = rows.select(F.col(at["page_id"]).cast("long").alias("page_id"), F.coalesce(host(url), F.lit("")).alias("host"), F.coalesce(path(url), F.lit("")).alias("path"), address(url).alias("node"))
    own = with_rule(own, rules)
    roots = connected(edges)
    link = F.concat(F.lit("http://"), "node")
    ruled = with_rule(roots.select("root", host(link).alias("host"), path(link).alias("path")), rules)
    bad = ruled.groupBy("root").agg(F.bool_or(~F.col("allowed")).alias("bad")).where("bad")
    blocked = durable(roots.join(bad, "root").select(F.col("node").alias("_node")))
    out = own.join(small_or_shuffled(blocked), F.col("node") == F.col("_node"), "left")
    inherited = F.col("rule").isNull() & F.col("_node").isNotNull()
    verdict = F.when(F.col("rule").isNotNull(), F.when(F.col("allowed"), "allow").otherwise("block")).when(inherited, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), inherited.alias("inherited"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES).drop("inherited")


#: Nodes, edges and components as above; the components by recursion, which SQL walks from every node of an edge.
OP8_SQL = r"""
WITH RECURSIVE parts AS (
  SELECT page_id, html, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, html, rest, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^#]*)', 1) AS tail FROM parts),
links AS (
  SELECT host, path, host || tail AS a, replace(unnest(list_concat(
    list_transform(regexp_extract_all(html, '(?i)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0), lambda t: regexp_extract(t, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)),
    list_transform(regexp_extract_all(html, '(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0), lambda t: regexp_extract(t, '(?i)\burl\s*=\s*["'']?([^"''\s>;]+)', 1)))), '&amp;', '&') AS href FROM p WHERE host <> ''),
ways AS (
  SELECT *, regexp_replace(CASE WHEN href LIKE '/%' THEN '' ELSE '/' || regexp_extract(path, '^/?(.*/)?[^/]*$', 1) END || regexp_extract(href, '^([^?#]*)', 1), '/(\.\.?)$', '/\1/') AS way,
    regexp_extract(href, '^[^?#]*([^#]*)', 1) AS query FROM links WHERE href <> ''),
targets AS (
  SELECT a, CASE WHEN position('://' IN href) > 0 THEN substr(href, position('://' IN href) + 3) WHEN href LIKE '//%' THEN substr(href, 3)
    WHEN regexp_matches(href, '^([A-Za-z][A-Za-z0-9+.-]*:|#)') THEN NULL WHEN href LIKE '?%' THEN host || path || query
    ELSE host || list_reduce(list_concat([''], string_split(way, '/')[2:]), lambda done, x: CASE WHEN x = '..' THEN regexp_replace(done, '/[^/]*$', '') WHEN x = '.' THEN done ELSE done || '/' || x END) || query END AS t FROM ways),
edges AS (
  SELECT DISTINCT a, translate(regexp_extract(t, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(t, '^[^/?#]*([^#]*)', 1) AS b FROM targets WHERE regexp_extract(t, '^([^/?#]*)', 1) <> ''),
both_ways AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
rules(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
urls AS (
  SELECT host, path FROM p UNION
  SELECT regexp_extract(b, '^([^/?#]*)', 1), regexp_extract(b, '^[^/?#]*([^?#]*)', 1) FROM reach),
ruled AS (
  SELECT host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM urls JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY host, path),
bad AS (
  SELECT DISTINCT r.a FROM reach r JOIN ruled u ON u.host = regexp_extract(r.b, '^([^/?#]*)', 1) AND u.path = regexp_extract(r.b, '^[^/?#]*([^?#]*)', 1) WHERE u.verdict = 'block')
SELECT p.page_id, p.host, p.path, ruled.rule, coalesce(ruled.verdict, CASE WHEN bad.a IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN ruled ON p.host = ruled.host AND p.path = ruled.path LEFT JOIN bad ON p.host <> '' AND bad.a = p.host || p.tail
"""
