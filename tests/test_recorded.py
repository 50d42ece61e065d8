"""Recorded answers through the data source: kinds, barriers, retries, pushed filters, and the same albums as from tables of answers."""

import json
from urllib.parse import quote

from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In

from parlux.sources import recorded as R
from parlux.sources import services as S


def recording(tmp_path, **services):
    for service, found in services.items():
        (tmp_path / service).mkdir(exist_ok=True)
        for name, answer in found.items():
            text = answer if isinstance(answer, str) else json.dumps(answer)
            (tmp_path / service / f"{quote(name, safe='.')}.json").write_text(text)
    return f"file://{tmp_path}"


def meta(name, mime="image/jpeg", **more):
    return {"id": name, "title": f"T{name}", "mimeType": mime, "downloadUrl": f"http://d/{name}"} | more


def test_kinds_and_barrier(spark, tmp_path):
    error = lambda code, message="x": {"error": {"code": code, "message": message}}
    found = {"a": meta("a"), "b/?": meta("b/?", thumbnailLink="u=s220"), "no": "no json", "list": [1], "401": error(401), "again": error(401), "again.retry": meta("again"), "twice": error(401), "twice.retry": error(401), "404": error(404), "net": error(-1, "a network error"), "odd": error(-1), "code": error(500), "number": meta("n", title=5), "untitled": {"id": "u", "mimeType": "m"}, "text": {"error": "x"}}
    found["b%2F%3F"] = found.pop("b/?")
    folder = recording(tmp_path, files={})
    for name, answer in found.items():
        (tmp_path / "files" / f"{name}.json").write_text(answer if isinstance(answer, str) else json.dumps(answer))
    ids = ["a", "b/?", "no", "list", "401", "again", "twice", "404", "net", "odd", "code", "number", "untitled", "text", "gone"]
    df = R.answers(spark, folder, "files", {"all": ids, "fine": ["b/?", "a", "a"], "none": []})
    rows = {(r.request, r.pos): r for r in df.collect()}
    kinds = ["OK", "OK", "UNEXPECTED", "UNEXPECTED", "DENIED", "OK", "DENIED", "NOT_FOUND", "NETWORK", "UNEXPECTED", "UNEXPECTED", "UNEXPECTED", "UNEXPECTED", "UNEXPECTED", "NOT_FOUND"]
    assert [(rows["all", k].id, rows["all", k].kind) for k in range(len(ids))] == list(zip(ids, kinds, strict=True))
    assert {r.complete for r in rows.values() if r.request == "all"} == {False} and {r.complete for r in rows.values() if r.request == "fine"} == {True}
    assert [rows["fine", k].title for k in range(3)] == ["Tb/?", "Ta", "Ta"] and rows["fine", 0].thumbnail_link == "u=s220" and len(rows) == 18
    assert df.rdd.getNumPartitions() == 3  # a request a partition


def test_pushed_filters(spark, tmp_path):
    folder = recording(tmp_path, files={"a": meta("a"), "b": meta("b", "image/mpo"), "t": meta("t", "text/plain")})
    df = R.answers(spark, folder, "files", {"x": ["a", "b", "t", "gone"], "y": ["a"], "z": ["t"]}, push=True)
    some = df.where(F.col("mime").isin("image/jpeg", "image/mpo") & (F.col("kind") == "OK") & (F.col("request") == "x"))
    reader = R.PushingReader({"service": "files", "path": folder, "requests": json.dumps({"x": ["a", "t"], "y": ["b"]})})
    asked = [EqualTo(("request",), "x"), In(("mime",), ("image/jpeg", "image/mpo")), In(("mime",), ("image/jpeg",)), EqualTo(("title",), "Ta")]
    assert list(reader.pushFilters(asked)) == asked[3:] and reader.wanted == {"request": {"x"}, "mime": {"image/jpeg"}}
    (part,) = reader.partitions()
    assert [b.column("id").to_pylist() for b in reader.read(part)] == [["a"]]  # what isn't wanted does not leave the reader
    # one scan with filters and one without, joined
    plan = some._jdf.queryExecution().executedPlan().toString()
    left = [x for x in plan.splitlines() if "Filter" in x and "BatchScan" not in x]
    assert not any(x in line for line in left for x in ("image/", "OK", "IN"))  # only tests for null are left to Spark
    plain = R.answers(spark, folder, "files", {"x": ["a", "b", "t", "gone"], "y": ["a"], "z": ["t"]})
    both = plain.groupBy("request").agg(F.count("*").alias("n")).join(plain.where("mime = 'image/jpeg'").groupBy("request").agg(F.count("*").alias("m")), "request")
    assert {tuple(r) for r in both.collect()} == {("x", 4, 1), ("y", 1, 1)}
    assert [(r.id, r.complete) for r in some.orderBy("pos").collect()] == [("a", False), ("b", False)]
    assert some.rdd.getNumPartitions() == 1  # other requests are not planned
    again = lambda: R.answers(spark, folder, "files", {"x": ["a", "b", "t", "gone"], "y": ["a"], "z": ["t"]}, push=True)
    assert again().where("title like 'T%' and pos > 0").count() == 2 and again().where("mime is null").count() == 1
    assert again().where("mime in ('image/jpeg', 'image/mpo') and mime in ('image/mpo', 'image/png')").count() == 1


def test_folders_as_from_tables(spark, tmp_path):
    files = {"f": meta("f", "folder"), "g": meta("g", "folder"), "t": meta("t", "text/plain")} | {f"p{k}": meta(f"p{k}", title=f"{k % 5}") for k in range(40)}
    lists = {"f": [*(f"p{k}" for k in range(39, -1, -1)), "t"], "g": ["p1", "gone"], "e": [], "many": [f"p{k % 40}" for k in range(S.CHILDREN + 50)]}
    answers = {k: {"kind": R.LISTING, "items": [{"id": x} for x in v]} for k, v in lists.items()}
    folder = recording(tmp_path, files=files, folders=answers | {"bad": "{", "odd": {"kind": "else", "items": []}, "half": {"items": [{"id": 5}]}})
    ids = spark.createDataFrame([(x,) for x in [*lists, "bad", "odd", "half", "absent"]], "folder_id string")
    got = R.load_folders(spark, folder, ids)
    want = S.folder_albums(spark.createDataFrame([(k, json.dumps(v)) for k, v in answers.items()], "folder_id string, answer string"), spark.createDataFrame([(json.dumps(m),) for m in files.values()], "answer string"))
    for a, b in zip(got, want, strict=True):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))
    assert got[1].where("folder_id = 'f'").count() == 40
    kinds = {r.id: r.kind for r in R.answers(spark, folder, "folders", {"x": ["bad", "odd", "half", "absent", "e"]}).collect()}
    assert kinds == {"bad": "UNEXPECTED", "odd": "UNEXPECTED", "half": "UNEXPECTED", "absent": "NOT_FOUND", "e": "OK"}


def test_long_listing(spark, tmp_path):
    """Every child of a listing counts, however many; one that isn't recorded, far behind, leaves the folder incomplete."""
    n = 2 * S.CHILDREN + 5
    lists = {"a/b": [f"p{k % 7}" for k in range(n)], "lost": [*(f"p{k % 7}" for k in range(n)), "gone"], "whole": ["p0"] * S.CHILDREN}
    files = {f"p{k}": meta(f"p{k}", title="same") for k in range(7)} | {k: meta(k, "folder") for k in lists}
    (tmp_path / "files").mkdir()
    folder = recording(tmp_path, folders={k: {"items": [{"id": x} for x in v]} for k, v in lists.items() if k != "a/b"}, files={k: v for k, v in files.items() if k != "a/b"})
    for service, found in {"folders": {"items": [{"id": x} for x in lists["a/b"]]}, "files": files["a/b"]}.items():
        (tmp_path / service / "a%2Fb.json").write_text(json.dumps(found))
    albums, photos = R.load_folders(spark, folder, spark.createDataFrame([(k,) for k in lists], "folder_id string"))
    assert {tuple(r) for r in albums.collect()} == {("a/b", "Ta/b", True), ("lost", "Tlost", False), ("whole", "Twhole", True)}
    got = photos.orderBy("place").collect()
    assert [r.photo_id for r in got if r.folder_id == "a/b"] == lists["a/b"] and [r.place for r in got if r.folder_id == "a/b"] == list(range(1, n + 1))
    assert len(got) == n + S.CHILDREN


def test_feeds(spark, tmp_path):
    entry = {"gphoto$id": {"$t": "1"}, "title": {"$t": "t"}, "content": {"type": "image/png", "src": "http://h/a"}}
    folder = recording(tmp_path, feeds={"1": {"feed": {"title": {"$t": "one"}, "entry": [entry, entry]}}, "2": {"none": 1}, "3": "{"})
    ids = spark.createDataFrame([(str(k), "given") for k in range(1, 5)], "album_id string, name string")
    albums, photos = R.load_feeds(spark, folder, ids)
    assert {tuple(r) for r in albums.collect()} == {("1", "one", "OK"), ("2", "given", "UNEXPECTED"), ("3", "given", "UNEXPECTED"), ("4", "given", "NOT_FOUND")}
    assert photos.count() == 2 and R.load_feeds(spark, folder, ids.where("false"))[0].count() == 0
