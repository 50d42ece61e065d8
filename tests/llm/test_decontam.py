"""Decontamination against SQL and brute force over words."""

import random
import re
from collections import Counter

import duckdb
import pytest

from parlux.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def windows_of(text, size):
    w = split(text)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(docs, items, size=10):
    out = []
    by = {}
    for item, text in items:
        if item is not None:
            for x in windows_of(text, size):
                by.setdefault(x, set()).add(item)
    for doc, text in docs:
        w, hit, seen = split(text), set(), set()
        for x, owners in by.items():
            for i in range(len(w) - len(x) + 1):
                if w[i : i + len(x)] == list(x):
                    hit |= set(range(i, i + len(x)))
                    seen |= owners
        out.append((doc, len(w), len(hit), tuple(sorted(map(str, seen)))))
    return out


def tables(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, segment int, hits string")
    return d, spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, window int")


def drawn(seed):
    """Texts of few words, so that windows occur often, in part and across the ends of texts."""
    draw = random.Random(seed)
    say = lambda n: " ".join(draw.choice(["aa", "Bb", "c-d", "é", "x9", "ÉÀ", "q\x7fr", "zz"]) for _ in range(n))
    items = [(k, say(draw.choice([0, 1, 3, 6]))) for k in range(8)] + [(10, None), (None, say(2)), (9, "aa!Bb"), (9, "zz zz")]
    docs = [(k, say(draw.choice([0, 1, 5, 40]))) for k in range(40)] + [(None, "aa bb"), (50, None), (50, None), (51, ""), (52, "aa " * 3000 + "bb")]
    return docs, items


def test_against_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(decontam.OP12_SQL)
    names = [c[0] for c in want.description]
    got = [tuple(r) for r in decontam.op12_decontam(spark, sf).select(*names).collect()]
    assert Counter(got) == Counter(want.fetchall())
    assert any(r[names.index("contaminated")] for r in got)


@pytest.mark.parametrize(("seed", "group", "size"), [(0, 1 << 24, 10), (1, 200, 4), (2, 60, 2)])
def test_against_brute_force(spark, monkeypatch, seed, group, size):
    """Also with windows in several groups, and with several documents in a segment."""
    monkeypatch.setattr(decontam, "GROUP", group)
    docs, items = drawn(seed)
    d, b = tables(spark, docs, items)
    got = [(r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontam.contamination(d.repartition(3), b, size).collect()]
    assert Counter(got) == Counter(brute(docs, items, size))
    assert decontam.contamination(d.where("false"), b).count() == 0
    assert all(r.n_hit == 0 for r in decontam.contamination(d, b.where("false")).collect())


@pytest.mark.parametrize("slack", [1, 2])
def test_proximity(spark, slack):
    docs, items = drawn(3)
    docs = docs[:-1] + [(60, "one two so three four very five"), (61, "two one three four five"), (62, "one two three four five")]
    items = [*items, (77, "one two three four five")]
    d, b = tables(spark, docs, items)
    got = decontam.find_matches(decontam.build_index(d.repartition(2)), b, slack, window=5).collect()
    want = []
    for doc, text in docs:
        w = split(text)
        for item, t in items:
            for x in windows_of(t, 5) if item is not None else ():
                near = lambda s, off, x=x, w=w: all(any(0 <= s + j + k < len(w) and w[s + j + k] == y for k in range(-off, off + 1)) for j, y in enumerate(x))
                exact = [s for s in range(len(w)) if near(s, 0)]
                loose = [s for s in range(-slack, len(w) + slack) if near(s, slack) and not any(abs(s - e) <= slack for e in exact)]
                want += [(doc, item, "phrase", s, len(x)) for s in exact] + [(doc, item, "near", s, len(x)) for s in loose if s - 1 not in loose]
    assert Counter((r.doc_id, r.item_id, r.kind, r.start, r.length) for r in got) == Counter(want)
    kinds = {(r.doc_id, r.kind) for r in got if r.item_id == 77}
    assert kinds == {(61, "near"), (62, "phrase")} | ({(60, "near")} if slack == 2 else {(60, "near")} & kinds)
    with pytest.raises(ValueError):
        decontam.find_matches(d, b, slack=40)
