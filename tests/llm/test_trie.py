"""The prefix trie against SQL and brute force over sequences of turns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from parlux.llm import trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, depth int, h string"


def brute(rows, shared=True):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in by.items()}
    whole = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if shared else 0
        whole[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + t[h:]
    members = defaultdict(list)
    for c, t in whole.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * len(WORD.findall(p[-1][1])) if p else 0
    ends = lambda p, m: hashlib.sha256(",".join(str(c) for c in sorted(m) if len(whole[c]) == len(p)).encode()).hexdigest()
    return Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]) if p in children else 0, leaves[p], saved[p], ends(p, m)) for p, m in members.items())


def frame(spark, rows):
    return spark.createDataFrame([(*r, 5, "clash") for r in rows], SCHEMA)


def drawn(seed, n=60):
    draw = random.Random(seed)
    say = lambda: draw.choice([None, "", "a", "a b", "x " * 40, "c" * 100, "c" * 100 + "d"])
    rows = [(conv, draw.choice([None, t, t]), draw.choice(["user", "assistant", None, ""]), say()) for conv in [*range(-25, n), None] for t in range(draw.choice([0, 1, 2, 3, 6]))]
    return rows + [(60, None, "u", "same"), (60, None, "u", "same"), (1 << 60, 0, "u", "far"), (-(1 << 60), 0, "u", "far"), (2, 3, "u", "word " * 50_000)]


def test_against_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = con.execute(trie.OP11_SQL)
    names = [c[0] for c in want.description]
    got = trie.op11_trie(spark, sf)
    assert sorted(got.columns) == sorted(names)
    assert Counter(tuple(r) for r in got.select(*names).collect()) == Counter(want.fetchall())


@pytest.mark.parametrize(("seed", "bits", "piece"), [(0, 64, 16), (1, 3, 1), (2, 0, 2)])
def test_against_brute_force(spark, monkeypatch, seed, bits, piece):
    """Also with fingerprints of few bits or none, so that nearly all collide and only the verification tells nodes apart, and with lists
    of ids in many pieces."""
    monkeypatch.setattr(trie, "BITS", bits)
    monkeypatch.setattr(trie, "PIECE", piece)
    rows = drawn(seed)
    df = frame(spark, rows).repartition(7)
    assert Counter(tuple(r) for r in trie._trie(*trie.with_shared_heads(df)).select(*COLUMNS).collect()) == brute(rows)
    if seed == 1:
        assert Counter(tuple(r) for r in trie.prefix_trie(df).select(*COLUMNS).collect()) == brute(rows, False)


def test_sql_of_odd_rows(spark):
    rows = drawn(4)
    con = duckdb.connect()
    table = frame(spark, rows).toArrow()
    con.register("conversations", table)
    want = con.execute(trie.OP11_SQL)
    names = [c[0] for c in want.description]
    assert Counter(want.fetchall()) == Counter(tuple(r[COLUMNS.index(n)] for n in names) for r in brute(rows).elements())


def test_one_long_conversation_over_many_partitions(spark):
    """A third and more of all rows are one conversation; skipped turns and fingerprints go on across partitions."""
    rows = [(21, t, "user", str(t % 7)) for t in range(250)] + [(20, t, "user", str(t % 5)) for t in range(2)] + [(c, 0, "user", "0") for c in range(40, 400)]
    assert Counter(tuple(r) for r in trie._trie(*trie.with_shared_heads(frame(spark, rows).repartition(9))).select(*COLUMNS).collect()) == brute(rows)


def test_empty(spark):
    empty = frame(spark, [(1, 0, "a", "b")]).where("false")
    assert trie.prefix_trie(empty).count() == 0
    only = frame(spark, [(20, 0, "a", "b"), (23, 0, "a", "b")])
    assert Counter(tuple(r) for r in trie._trie(*trie.with_shared_heads(only)).select(*COLUMNS).collect()) == brute([(20, 0, "a", "b"), (23, 0, "a", "b")])
