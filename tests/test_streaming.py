"""Streams with state: notices that hide by themselves, lists that are merged anew with each batch."""

import random
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from parlux.functions import media as M
from parlux.streaming import flows, merging, notices

BEGIN = datetime(2024, 1, 1)


def test_notices(spark, tmp_path):
    """A replayed stream of several files gives out what the batch gives, without a later notice in most places."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", notices.PROVIDER)
    draw = random.Random(7)
    rows = []
    for part in range(4):
        rows.append([(draw.randrange(6), BEGIN + timedelta(seconds=20 * part + draw.randrange(20), microseconds=draw.choice([0, 1, 999])), 100 * part + k, draw.choice(["a", "b", None]), draw.choice([None, 0, 900, 30_000])) for k in range(25)])
    # rows of one file come in any order; the last one passes all others by far
    rows.append([(99, BEGIN + timedelta(hours=5), 999, None, None)])
    schema = "place int, ts timestamp, n int, message string, ms int"
    for part, some in enumerate(rows):
        draw.shuffle(some)
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/part{part}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    shown = notices.shown_stream(stream, "place", "ts", "n", "message", F.col("ms"), "10 minutes")
    query = shown.writeStream.format("memory").queryName("notices").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    want = flows.shown(spark.createDataFrame([r for some in rows for r in some], schema), "place", "ts", "n", "message", F.col("ms"))
    got = spark.table("notices").collect()
    assert Counter((r.place, r.ts, r.n, r.message, r.until) for r in got) == Counter((r.place, r.ts, r.n, r.message, r.until) for r in want.collect()) and len(got) > 40
    assert any(r.until - r.ts == timedelta(milliseconds=M.NOTICE_MS) for r in got)


def test_lists(spark, tmp_path):
    """After each batch the list is what appending to it gives, its actions lead from one list to the next, and a replay changes nothing."""
    draw = random.Random(3)
    schema = "album long, seq long, photo_id string, state string"
    batches = [[(draw.randrange(3), 100 * b + k, draw.choice(["p", "q", "r", "s", "t", None]), draw.choice(["PENDING", "LOADED", "LOADING"])) for k in range(6)] for b in range(3)]
    for b, some in enumerate(batches):
        spark.createDataFrame(some, schema).coalesce(1).write.parquet(f"{tmp_path}/in/b{b}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    folder = f"file://{tmp_path}/kept"
    query = merging.merging(stream, spark, folder, f"{tmp_path}/c")
    query.awaitTermination(240)
    assert query.exception() is None
    kept = merging.KeptLists(spark, folder)
    assert kept.last() == 2 and not kept.has(3) and kept.lists(7).count() == 0

    def rows(df):
        return sorted(((r.album, r.pos, r.photo_id, r.state) for r in df.collect()), key=str)

    versions = [rows(kept.lists(v)) for v in range(3)]
    mine: dict = {}
    left = list(batches)
    for version in range(3):
        for some in left:  # the batch that this version took
            tried = {a: list(x) for a, x in mine.items()}
            for album in {r[0] for r in some}:
                have = tried.get(album, [])
                news = {r[2]: r[3] for r in sorted((r for r in some if r[0] == album), key=lambda r: r[1])}
                had = {p for p, _ in have if p is not None}
                tried[album] = [(p, news.get(p, s) if p is not None else s) for p, s in have] + [(r[2], r[3]) for r in sorted((r for r in some if r[0] == album), key=lambda r: r[1]) if r[2] not in had]
            if sorted(((a, k, p, s) for a, x in tried.items() for k, (p, s) in enumerate(x)), key=str) == sorted(versions[version], key=str):
                mine = tried
                left.remove(some)
                break
        else:
            raise AssertionError(f"version {version} is no list that a batch makes")
        before = {(a, k): p for a, k, p, _ in (versions[version - 1] if version else [])}
        for r in kept.actions(version).collect():
            assert r.action in ("insert", "replace") and ((r.album, r.pos) in before) == (r.action == "replace")
            before[r.album, r.pos] = r.photo_id
        assert before == {(a, k): p for a, k, p, _ in versions[version]}
    # a batch that comes again, and one that removes
    merging.merge_batch(kept, spark.createDataFrame([(0, 0, "new", "PENDING")], schema), 2)
    assert rows(kept.lists(2)) == versions[2]
    merging.merge_batch(kept, spark.createDataFrame([(0, 0, "only", "PENDING")], schema), 3, removed=spark.createDataFrame([(0,), (1,)], "album long"))
    assert [r[1:] for r in rows(kept.lists(3)) if r[0] < 2] == [(0, "only", "PENDING")] and {r.action for r in kept.actions(3).collect()} >= {"remove"}
    ask = spark.createDataFrame([(0, 0), (2, 0)], "album long, pos int")
    assert (0, 0) in {tuple(r) for r in merging.next_to_load(kept, ask).collect()}
