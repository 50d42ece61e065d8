"""Vector codes against SQL and brute force in Python's integers."""

import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from parlux.llm import codes


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    """(vec_id, label, code, error) of each kept row, label -> error, digest."""
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dims = -(-max((len(v) for _, v, _ in kept), default=0) // parts) * parts

    def whole(v):
        ratios = [x.as_integer_ratio() for x in v]
        return [scale * a // b for a, b in ratios] + [0] * (dims - len(v))

    width = dims // parts
    ints = [whole(v) for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[ints[k][p * width : (p + 1) * width] for k in order] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for turn in range(rounds + 1):
        got = [[min((far(v[p * width : (p + 1) * width], e), k) for k, e in enumerate(books[p])) for p in range(parts)] for v in ints]
        if turn == rounds:
            break
        for p in range(parts):
            mine = defaultdict(list)
            for v, g in zip(ints, got, strict=True):
                mine[g[p][1]].append(v[p * width : (p + 1) * width])
            books[p] = [[sum(c) // len(c) for c in zip(*mine[k], strict=True)] if k in mine else e for k, e in enumerate(books[p])]
    by = defaultdict(int)
    out = []
    for (i, _, lab), g in zip(kept, got, strict=True):
        error = sum(f for f, _ in g)
        by[lab] += error
        out.append((i, lab, "".join(f"{k:02x}" for _, k in g), error))
    most = (1 << 63) - 1
    return [(i, code, min(e, most), min(by[lab], most)) for i, lab, code, e in out], codes.Codebooks(books, dims).digest()


def found(df, **kw):
    coded, books = codes.compress(df, **kw)
    return [(r.vec_id, r.code, r.error, r.label_error) for r in codes.with_label_errors(coded).collect()], books.digest()


SCHEMA = "vec_id long, embedding array<double>, label int, code string, _label int, extra string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, "clash", 7, None) for i, v, lab in rows], SCHEMA)


def test_against_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.execute(codes.OP13_SQL)
    names = [c[0] for c in want.description]
    got = codes.op13_codes(spark, sf)
    assert Counter(tuple(r) for r in got.select(*names).collect()) == Counter(want.fetchall())


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    """Ties, equal vectors, repeated and null ids, null labels, odd lengths and vectors that take no part."""
    draw = random.Random(seed)
    near = lambda n: [draw.choice([-0.001, 0.0, 0.0002, 0.25, -0.25, draw.gauss(0, 1)]) for _ in range(n)]
    rows = [(draw.choice([None, *range(40)]), near(draw.choice([16, 16, 16, 3, 0])), draw.choice([None, 0, 1])) for _ in range(90)]
    rows += [(100, None, 1), (-5, [0.5, None], 1), (-6, [float("nan")] * 16, None), (-7, [float("inf")] * 16, 1)] + rows[:5]
    got, digest = found(frame(spark, rows).repartition(5))
    want, want_digest = brute(rows)
    assert digest == want_digest and Counter(got) == Counter(want)


def test_huge_components_and_few_rows(spark):
    rows = [(k, [(-1.0) ** k * 10.0 ** (k % 7 * 50), 1.5 * k, -0.3, 7e20], k % 2) for k in range(30)]
    assert found(frame(spark, rows), parts=2, entries=4, rounds=3) == brute(rows, 2, 4, 3)
    few = rows[:3]
    assert found(frame(spark, few)) == brute(few)
    assert found(frame(spark, few).where("false"))[0] == []


def test_bounds_hold_and_filter():
    """Bounds enclose the distance of every entry, so the nearest is always among the candidates; far entries are left out."""
    rng = np.random.default_rng(5)
    for width, bits in ((1, 1), (3, 2), (8, 3)):
        entries = rng.integers(-3000, 3000, (16, width))
        entries[3] = entries[7]
        search = codes.CellFilter(entries.tolist(), bits)
        parts = rng.integers(-3000, 3000, (500, width))
        far = ((parts[:, None, :] - entries[None]) ** 2).sum(2)
        entry, error = search.nearest(parts)
        assert (entry == far.argmin(1)).all() and (error == far.min(1)).all()


def test_limbs():
    for x in (0, -1, 5, -(1 << 40), 1 << 40, -(10**60), 10**60 + 7):
        assert sum(v << (codes.LIMB * k) for k, v in enumerate(codes._limbs(x))) == x
        assert all(abs(v) <= 1 << codes.LIMB for v in codes._limbs(x))
