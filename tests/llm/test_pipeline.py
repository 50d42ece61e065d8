"""The pipeline as a whole and stage by stage against brute force, and odd tables for every operator."""

import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tests.llm.test_operators import ODD, WORD, components, same
from tokenizers import Tokenizer

from parlux.llm import _durable, chat, mixing, neardup, packing, pii, quality, records, token_counts, topk, url_filter


def good(text):
    """The quality rules, read word by word."""
    text = text or ""
    words = WORD.findall(text)
    count = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {i + k for i in range(len(words) - 4) if count[tuple(words[i : i + 5])] > 1 for k in range(5)}
    if len(words) < 10 or 100 * len(inside) > 20 * len(words):
        return False
    chars = sum(map(len, words))
    for n, most in quality.MAX_REPEATED.items():
        seen, later = set(), set()
        for i in range(len(words) - n + 1):
            gram = tuple(words[i : i + n])
            if gram in seen:
                later |= set(range(i, i + n))
            seen.add(gram)
        if sum(len(words[i]) for i in later) > most * chars:
            return False
    lines, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += sum(map(len, WORD.findall(line))) if line in lines else 0
            lines.add(line)
    return again <= quality.MAX_LINE_CHARS * chars


def key(row):
    return (row.doc_id is not None, row.doc_id or 0)


@pytest.fixture(scope="module")
def table(spark, sf, tmp_path_factory):
    """A folder with documents, odd ones among them."""
    path = str(tmp_path_factory.mktemp("sf"))
    real = spark.read.parquet(f"{sf}/documents.parquet")
    again = real.where("doc_id % 9 = 0")
    real.unionByName(spark.createDataFrame(ODD, real.schema)).unionByName(again).write.parquet(f"{path}/documents.parquet")
    return path


def test_stages(spark, table):
    docs = spark.read.parquet(f"{table}/documents.parquet")
    rows, tok, found = docs.collect(), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, table)
        path = f"{table}/stage-{k}"
        out.write.parquet(path)
        if k < 4:
            assert out.columns == docs.columns
        docs = spark.read.parquet(path)
        found.append(docs.collect())
    passed, first, clean, mixed, packed = found
    same(passed, [r for r in rows if good(r.text)])
    _, _, root = components(passed, 5)
    groups = defaultdict(list)
    for r, g in zip(passed, root, strict=True):
        groups[g].append(r)
    assert len(first) == len(groups)
    same([r.doc_id for r in first], [min(g, key=lambda r: (r.doc_id is None, r.doc_id or 0)).doc_id for g in groups.values()])
    assert set(first) <= set(passed)
    brute = [pii.replaced(r.text, pii.KEY, {}) for r in first]
    same([(r.doc_id, r.text, r.n_chars) for r in clean], [(r.doc_id, t, None if r.n_chars is None else len(t)) for r, t in zip(first, brute, strict=True)])
    copies = {(p.doc_id, p.source): p.copies for p in mixing.plan_mixture(spark.createDataFrame(clean)).collect()}
    same([(r.doc_id, r.text) for r in mixed], [(r.doc_id, r.text) for r in clean for _ in range(copies[r.doc_id, r.source])])
    want = Counter()
    for r in mixed:
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [0]
        cuts = [0, *[c for c in range(len(ids) % 2048, len(ids) + 1, 2048) if c]] if len(ids) > 2048 else [0, len(ids)]
        want.update((r.doc_id, a, tuple(ids[a:b])) for a, b in zip(cuts, cuts[1:], strict=False))
    assert Counter((r.doc_id, r.start, tuple(r.ids)) for r in packed) == want
    assert all(r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r.ids)) for r in packed)
    whole = corpus_pipeline.run(spark, table)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    same([tuple(r) for r in whole.select(*names).collect()], [tuple(getattr(r, n) for n in names) for r in packed])


def test_stages_of_an_empty_table(spark, table):
    docs = spark.read.parquet(f"{table}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, table).count() == 0


CLASHING = ["_doc", "_text_key", "text_key", "size", "rate", "node", "root", "n", "_row", "_choices", "copies", "seed", "c0", "_hash", "v", "range", "conv", "k0", "host", "rule", "verdict", "kept", "_id", "_key"]


def test_clashing_columns(spark, sf, table):
    """Further columns with names that operators use themselves change nothing and come back as they were."""
    odd = lambda df: df.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHING if c not in df.columns))
    docs = spark.read.parquet(f"{table}/documents.parquet")
    wide = odd(docs)
    path, model, out = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), f"file://{table}/clash"
    for f in (mixing.plan_mixture, quality.quality, lambda d: neardup.near_duplicates(d).drop("root"), lambda d: token_counts.count_tokens(d, model), lambda d: packing.pack(d, path).drop("sequence_id", "offset")):
        same(f(wide).collect(), f(docs).collect())
    assert records.write_records(wide, path, out).agg(F.sum("records")).first()[0] == docs.count()
    for f in (mixing.mix_sources, quality.keep_good, neardup.keep_first, pii.replace_private):
        got = f(wide)
        assert got.columns == wide.columns and got.where(" and ".join(f"`{c}` = 'own {c}'" for c in CLASHING)).count() == got.count() == f(docs).count()
    vectors, pages, chats = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("embeddings", "pages", "conversations"))
    for f, df in ((lambda d: topk.top_k(d, F.col("vec_id") % 20 == 0), vectors), (lambda d: url_filter.filter_urls(d, url_filter.RULES), pages), (chat.format_chats, chats)):
        same(f(odd(df)).collect(), f(df).collect())


def test_very_long_texts(spark):
    word = "abcdefghij klmno "
    rows = [(1, word * 60_000), (2, "x" * 1_000_000), (3, f"Mail a.b@mail1.example.com {word * 20_000} then a.b@mail1.example.com")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_words for r in quality.quality(df).collect()} == {1: 120_000, 2: 1, 3: 40_004}
    got = {r.doc_id: r.text for r in pii.replace_private(df).collect()}
    assert got[1] == rows[0][1] and got[2] == rows[1][1] and len(re.findall(r"[a-z]\.[a-z]@[a-z]+[0-9]\.[a-z]+\.com", got[3])) == 2 and "a.b@mail1" not in got[3]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df).collect()} == {1: (2, 1), 2: (1, 2), 3: (len(set(zip(*(rows[2][1].split()[k:] for k in range(5)), strict=False))), 3)}
    page = spark.createDataFrame([(1, "http://a.com/" + "p/" * 100_000, "<p>" * 300_000 + '<link rel="canonical" href="http://b.net/">')], "page_id long, url string, html string")
    assert url_filter.filter_urls(page, url_filter.RULES).first().verdict == "block"


def test_components_take_logarithmic_rounds(spark, monkeypatch):
    calls, real = [0], _durable.durable
    monkeypatch.setattr(_durable, "durable", lambda df: (calls.__setitem__(0, calls[0] + 1), real(df))[1])
    chain = lambda n: spark.range(n).select(F.col("id").cast("string").alias("a"), (F.col("id") + 1).cast("string").alias("b"))
    star = spark.range(300).select(F.lit("hub").alias("a"), F.concat(F.lit("s"), "id").alias("b"))
    for edges, nodes, parts in ((chain(10), 11, 1), (chain(100), 101, 1), (chain(1000), 1001, 1), (star, 301, 1), (chain(100).union(star), 402, 2), (chain(10).where("false"), 0, 0)):
        calls[0] = 0
        got = _durable.connected(edges).collect()
        assert len(got) == len({r.node for r in got}) == nodes and len({r.root for r in got}) == parts
        assert calls[0] <= 1 + 3 * 2 * (nodes.bit_length() + 1)


def test_clusters_of_many_chunks(spark, monkeypatch):
    """Texts of one template: a cluster of candidates that is mostly not linked, in chunks of few texts, with near copies among them."""
    monkeypatch.setattr(neardup, "CHUNK", 300)
    monkeypatch.setattr(neardup, "CLOSE", 0.3)
    monkeypatch.setattr(neardup, "ROWS", 2)
    monkeypatch.setattr(neardup, "BANDS", 64)
    common = [f"c{k}" for k in range(60)]
    texts = [[*common, *(f"f{f}w{k}" for k in range(30)), *(f"m{f}x{m}y{k}" for k in range(4))] for f in range(30) for m in range(3)]
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    rows = df.collect()
    _, least, _ = components(rows, 5)
    assert len(set(least)) == 30
    same([(r.doc_id, r.component_id) for r in neardup.near_duplicates(df).collect()], [(r.doc_id, c) for r, c in zip(rows, least, strict=True)])


def test_top_k_of_huge_and_repeated_vectors(spark):
    vectors = [(20, [2.0, 1.0]), (20, [-1.0, 0.5]), (1, [4e7, 1.0]), (2, [1.0, 2.0]), (3, [-4e7, 2.0]), (3, [0.25, 0.25]), (40, [1e30, -1e25]), (5, [1e30, 3e7]), (6, [2e7] * 64), (60, [2e7] * 64), (7, [])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    whole = [[int(64 * x // 1) for x in v] for v in [r.embedding for r in df.collect()]]
    ids = [r.vec_id for r in df.collect()]
    want = Counter()
    for q in (20, 40, 60):
        pairs = [(-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(x, y, strict=False)))), j) for i, x in zip(ids, whole, strict=True) if i == q for j, y in zip(ids, whole, strict=True) if j != q]
        want.update((q, rank, j, -s) for rank, (s, j) in enumerate(sorted(pairs)[:20], 1))
    assert Counter(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0).collect()) == want


def test_tied_turns(spark):
    import duckdb

    turns = [(c, 0, r, t) for c in range(7) for r, t in ([("user", "b"), ("user", "a"), ("assistant", "z"), (None, "q")][c % 3 :] + [("user", str(c))])]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.register("conversations", df.toPandas())
    same([tuple(r) for r in chat.format_chats(df).select("conv_id", "part", "n_turns", "n_equal", "text").collect()], con.execute(chat.OP3_SQL).fetchall())


def test_links_of_every_form(spark):
    import duckdb

    link, meta = '<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="0; url={}">'
    pages = [(1, "http://d.com/z/q", link.format("../k/./m?x=1#f") + meta.format("?id=3")), (2, "http://d.com/k/m?x=1", link.format("mailto:x") + link.format("//a.net/x")), (3, "http://d.com/z/q?id=3", None), (4, "http://e.com", link.format("rel.html")), (5, "http://e.com/rel.html", meta.format("http://a.net/x")), (6, "http://f.com/a/b/", link.format("..")), (7, "http://f.com/a/", link.format("http://example.com/de/1")), (8, "http://g.com/a", link.format("#top")), (None, None, link.format("/x")), (8, "http://g.com/a", None)]
    pages += [(100 + k, f"http://chain.com/{k}", link.format(f"/{k + 1}")) for k in range(40)] + [(200, "http://chain.com/40", link.format("http://x.net/"))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    con = duckdb.connect()
    con.register("pages", df.toPandas().astype({"page_id": "Int64"}))
    got = url_filter.filter_urls(df, url_filter.RULES).drop("inherited").collect()
    same([tuple(r) for r in got], con.execute(url_filter.OP8_SQL).fetchall())
    verdicts = {r.page_id: r.verdict for r in got}
    assert all(verdicts[k] == "block" for k in (1, 2, 3, 4, 5, 6, 7, 100, 139, 200)) and verdicts[8] == verdicts[None] == "allow"
    many = [("block", f"h{k}.com", "/") for k in range(100)] + [("allow", "h5.com", "/ok/")]
    some = spark.createDataFrame([(1, "http://a.h5.com/ok/x", None), (2, "http://h5.com/x", None), (3, "http://xh5.com/x", None)], "page_id long, url string, html string")
    assert {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(some, many).collect()} == {1: ("h5.com/ok/", "allow"), 2: ("h5.com/", "block"), 3: (None, "allow")}
    assert url_filter.filter_urls(some.where("false"), many).count() == 0
