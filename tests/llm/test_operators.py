"""Every operator against brute force (or SQL) on small tables, with odd rows among them."""

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from parlux.llm import _durable, chat, codes, mixing, neardup, packing, pii, quality, records, token_counts, topk, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "ab cd " * 3000 + "tail"
ODD = [
    (9001, None, "en", "s1", 0), (9002, "", "en", "s1", 0), (9003, " \n\t ", "en", None, 4), (None, "no id here at all", "en", "s2", 17), (9004, LONG, "en", "s2", len(LONG)),
    (9005, "same row twice", "en", "s1", 14), (9005, "same row twice", "en", "s1", 14), (9006, "a b c \u0085 ▁x", None, None, None), (9007, "<|endoftext|> x <s> </s>", "en", "s3", 5),
    (9008, "one two three four five six seven eight nine ten eleven twelve", "en", "s3", 5), (9009, "One two three four five six seven eight nine ten eleven twelve", "en", "s3", 5),
]


@pytest.fixture(scope="module")
def docs(spark, sf):
    real = spark.read.parquet(f"{sf}/documents.parquet")
    return real.unionByName(spark.createDataFrame(ODD, real.schema)).repartition(5).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def same(got, want):
    assert Counter(got) == Counter(want)


def sql(query, sf, **tables):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'") if t not in tables else con.register(t, tables[t])
    return con.execute(query)


def against_sql(df, query, sf, **tables):
    found = sql(query, sf, **tables)
    names = [c[0] for c in found.description]
    assert set(names) <= set(df.columns)
    same([tuple(r) for r in df.select(*names).collect()], found.fetchall())


def test_quality(docs, rows, empty):
    def brute(text):
        text = text or ""
        words = WORD.findall(text)
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        count = Counter(grams)
        inside = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(5)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        n = len(words)
        return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), n < 10 or 100 * len(inside) > 20 * n

    got = quality.quality(docs).collect()
    same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got], [(r.doc_id, *brute(r.text)) for r in rows])
    assert not any(r.kept and r.base_failed for r in got)
    kept = Counter(r.doc_id for r in got if r.kept)
    assert Counter(r.doc_id for r in quality.keep_good(docs).collect()) == kept
    assert quality.quality(empty).count() == 0


def test_quality_in_sql(spark, docs, sf):
    against_sql(quality.op5_quality(spark, sf), quality.OP5_SQL, sf)
    against_sql(quality.quality(docs), quality.OP5_SQL, sf, documents=docs.toArrow())


@pytest.mark.parametrize(("length", "times", "words"), [(10, 3, 160), (7, 3, 105), (5, 5, 125)])
def test_quality_by_each_length(spark, length, times, words):
    """A passage of so many words stands so many times in the text, so that just the rule of that n-gram length rejects it."""
    passage = [f"p{k:03}" for k in range(length)]
    unique = [f"w{k:03}" for k in range(words - times * length)]
    text = " ".join(w for k in range(times) for w in [*passage, *unique[k::times]])
    r = quality.quality(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    over = [n for n, most in quality.MAX_REPEATED.items() if r[f"dup_chars_{n}"] > most * r.word_chars]
    assert r.n_words == words and not r.base_failed and over == [length] and not r.kept


def shingle_set(text, n):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) or (frozenset([tuple(words)]) if words else frozenset())


def components(rows, n):
    sets = [shingle_set(r.text, n) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    least = {g: min((rows[i].doc_id for i in m if rows[i].doc_id is not None), default=None) for g, m in groups.items()}
    return sets, [least[find(i)] for i in range(len(rows))], [find(i) for i in range(len(rows))]


@pytest.mark.parametrize("n", [4, 5])
def test_near_duplicates(docs, rows, empty, n):
    sets, least, root = components(rows, n)
    got = neardup.near_duplicates(docs, n=n).collect()
    same([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got], [(r.doc_id, len(s), c, r.doc_id == c) for r, s, c in zip(rows, sets, least, strict=True)])
    if n == 5:
        assert neardup.keep_first(docs).count() == len({g for g, s in zip(root, sets, strict=True) if s}) + sum(not s for s in sets)
        assert neardup.near_duplicates(empty).count() == 0


def bpe():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def test_packing(docs, rows, empty):
    path, tok = public_tokenizers.path("byte_bpe_50k.json"), bpe()
    got = packing.pack(docs, path).collect()
    ids = [tok.encode(r.text or "", add_special_tokens=False).ids + [0] for r in rows]
    want = []
    for r, x in zip(rows, ids, strict=True):
        cuts = list(range(len(x) % 2048, len(x) + 1, 2048)) if len(x) > 2048 else [len(x)]
        cuts = [c for c in cuts if c]
        want += [(r.doc_id, k, a, b - a, crc(x[a:b])) for k, (a, b) in enumerate(zip([0, *cuts], cuts, strict=False))]
    same([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], want)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(map(len, ids)) // 2048) * 1.01 + 1
    assert packing.pack(empty, path).count() == 0


def test_records(spark, docs, rows, empty, tmp_path):
    path, tok = public_tokenizers.path("byte_bpe_50k.json"), bpe()
    out = f"file://{tmp_path}"
    got = sorted(records.read_records(records.write_records(docs, path, out), out).collect(), key=lambda r: r.start)
    want = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    at = 0
    for g, w in zip(got, want, strict=True):
        ids = tok.encode(w.text or "", add_special_tokens=False).ids + [2]
        assert (g.doc_id, g.start, g.n_tokens, list(g.ids)) == (w.doc_id, at, len(ids), ids)
        at += len(ids)
    damaged = bytearray(records.frame(b"payload"))
    damaged[-6] ^= 1
    with pytest.raises(ValueError):
        records.unframe(bytes(damaged))
    assert records.read_records(records.write_records(empty, path, out + "/none"), out + "/none").count() == 0


def test_token_counts(docs, rows, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    tok = sentencepiece.SentencePieceProcessor(model_file=path)
    got = token_counts.count_tokens(docs, path, 4096).collect()
    counts = [len(tok.encode(r.text or "")) for r in rows]
    same([(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got], [(r.doc_id, len((r.text or "").encode()), n, n > 4096) for r, n in zip(rows, counts, strict=True)])
    assert token_counts.count_tokens(empty, path).count() == 0


def test_mixing(docs, rows, empty):
    got = mixing.plan_mixture(docs).collect()
    size = Counter()
    for r in rows:
        size[r.source] += len(WORD.findall(r.text or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, target, free = 1.5 * sum(size.values()), {}, set(order)
    while True:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * size[s]}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * size[s] for s in over}
        free -= over
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source]) and r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in order:
        largest = max(len(WORD.findall(r.text or "")) for r in rows if r.source == s)
        assert abs(taken[s] - target[s]) <= max(largest, 0.05 * target[s])
    again = mixing.plan_mixture(docs.repartition(3)).collect()
    same([(r.doc_id, r.size, r.taken) for r in got], [(r.doc_id, r.size, r.taken) for r in again])
    mixed = mixing.mix_sources(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies for r in got)
    assert mixing.plan_mixture(empty).count() == 0 and mixing.mix_sources(empty).count() == 0


def test_top_k(spark, sf):
    from pyspark.sql import functions as F

    against_sql(topk.op2_topk(spark, sf), topk.OP2_SQL, sf)
    odd = spark.createDataFrame([(20, [1.0, 2.0]), (40, None), (60, [1.0, None]), (80, [float("nan"), 1.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [float("inf"), 0.0])], "vec_id long, embedding array<float>")
    same([tuple(r) for r in topk.top_k(odd, F.col("vec_id") % 20 == 0).select("query_id", "rank", "vec_id", "score").collect()], [(20, 1, 1, 20480), (20, 2, 2, 20480)])
    assert topk.top_k(odd.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_chat(spark, sf):
    against_sql(chat.op3_chat(spark, sf), chat.OP3_SQL, sf)
    turns = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (4, 0, "user", None), (5, 0, "user", ""), (5, 1, None, "x"), (None, None, "user", "q"), (6, 0, "user", "z"), (6, 0, "user", "z")]
    turns += [(7, k, "user", str(k)) for k in range(3000)] + [(8, k, "user", str(k)) for k in range(2500)] + [(9, k, "user", str(k) if k != 2000 else "") for k in range(2500)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = defaultdict(list)
    for r in chat.format_chats(df.repartition(7)).collect():
        got[r.conv_id].append(r)
    assert {c: (len(p), p[0].n_turns, p[0].n_equal) for c, p in got.items()} == {1: (1, 2, 2), 5: (1, 2, 1), None: (1, 1, 1), 6: (1, 1, 1), 7: (6, 3000, 1), 9: (5, 2500, 1)}
    whole = "".join(p.text for p in sorted(got[7], key=lambda p: p.part))
    assert whole == "".join(f"<|im_start|>user\n{k}<|im_end|>\n" for k in range(3000))
    assert chat.format_chats(df.where("false")).count() == 0


def test_url_filter(spark, sf):
    against_sql(url_filter.op8_url_filter(spark, sf), url_filter.OP8_SQL, sf)
    link = '<link rel="canonical" href="{}">'
    pages = [(1, "http://a.net/x", None), (2, "http://b.com/y", link.format("http://a.net/x")), (3, "http://example.net/en/1", link.format("http://b.com/y")), (4, "HTTP://C.COM", None), (5, None, "x"), (6, "nothing", None), (7, "http://d.com/z", link.format("/q")), (7, "http://d.com/z", link.format("/q"))]
    got = url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), url_filter.RULES).collect()
    assert {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in got} == {
        (1, "a.net", "/x", "net/", "block"), (2, "b.com", "/y", None, "block"), (3, "example.net", "/en/1", "example.net/en/", "allow"), (4, "c.com", "", None, "allow"), (5, "", "", None, "allow"), (6, "", "", None, "allow"), (7, "d.com", "/z", None, "allow"),
    }
    assert len(got) == 8
    redirects = spark.createDataFrame([("http://m.com/1", "http://a.net/x")], "from_url string, to_url string")
    one = url_filter.filter_urls(spark.createDataFrame([(1, "http://m.com/1", None)], "page_id long, url string, html string"), url_filter.RULES, redirects)
    assert one.first().verdict == "block"


def test_near_duplicates_in_split_buckets(spark, monkeypatch):
    """Families of near copies that all share one long passage. Every bucket is split into far more random parts than it has nodes,
    without pivots, so that only the comparison of what is still apart can find the families."""
    monkeypatch.setattr(neardup, "GROUP", 0.01)
    monkeypatch.setattr(neardup, "PIVOTS", 0)
    monkeypatch.setattr(neardup, "BLOCK", 5, raising=False)
    common = [f"c{k}" for k in range(80)]
    texts = [[*common, *(f"f{f}w{k}" for k in range(50)), *(f"m{f}x{m}y{k}" for k in range(6))] for f in range(25) for m in range(3)]
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    rows = df.collect()
    _, least, _ = components(rows, 5)
    assert len(set(least)) == 25
    same([(r.doc_id, r.component_id) for r in neardup.near_duplicates(df).collect()], [(r.doc_id, c) for r, c in zip(rows, least, strict=True)])


def test_joins_by_shuffle(spark, sf, monkeypatch):
    """Where tables are too large to be broadcast, the same rows come of joins by shuffle."""
    monkeypatch.setattr(_durable, "BROADCAST_BYTES", -1)
    against_sql(chat.op3_chat(spark, sf), chat.OP3_SQL, sf)
    against_sql(url_filter.op8_url_filter(spark, sf), url_filter.OP8_SQL, sf)
    against_sql(codes.op13_codes(spark, sf), codes.OP13_SQL, sf)
