"""A data source for recorded answers of services: folder listings, files' metadata and album feeds.

A recording is a folder of any file system that pyarrow opens by URI: <service>/<id>.json holds the answer to what was asked for an id
(ids are percent-encoded), <id>.retry.json the answer to a second try after an authorization that failed.

    spark.dataSource.register(RecordedAnswers)
    spark.read.format("recorded_answers").option("service", "files").option("requests", '{"trip": ["a", "b"]}').load("file:///recording")

What is asked for are requests, a name and its ids each: a JSON object in the option `requests`, or a folder of Parquet files (request
string, ids array<string>) in `requests_path`, of which the planner reads no rows: a partition is one request of the object, or one row
group, whose rows its task reads. Answers are read by the tasks, in the order of ids.

Every asked id has rows. kind is what came of it: OK, NOT_FOUND (nothing recorded, or the service says so), DENIED (a second try failed
as well), NETWORK (the recording can't be read) or UNEXPECTED (no JSON, or fields that are absent or of another type). complete says
whether all ids of the request are OK. With the option push, filters on request, id, kind, complete and, of files, mime go into
the reader: requests that aren't wanted are not read, other rows that aren't wanted are not sent (all ids of a request are read, as it
is judged as a whole). An unknown service is an error; a request without ids has no rows."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from parlux.functions import columns as C
from parlux.operators.shared import kept, shared_folder
from parlux.sources import services as S

_HEAD = "request string, pos int, id string, kind string, complete boolean"
#: The rows of each service: a file; a child of a folder (or one row without child); a feed's answer as it is.
SCHEMAS = {
    "files": f"{_HEAD}, title string, mime string, download_url string, thumbnail_link string",
    "folders": f"{_HEAD}, child_pos int, child_id string",
    "feeds": f"{_HEAD}, status int, answer string",
}
#: Columns whose filters the reader takes.
PUSHED = {"request", "id", "kind", "complete", "mime"}
#: Rows of an Arrow batch.
ROWS = 4096
#: Codes of errors, and what a listing calls itself.
DENIED, MISSING, UNREACHED, LISTING = 401, 404, -1, "drive#childList"


@dataclass
class Asked(InputPartition):
    """Requests by name, or a row group of a file of requests."""

    requests: dict[str, list[str]]
    path: str = ""
    group: int = 0


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _texts(found: object, *names: str) -> list[str | None] | None:
    """Fields of an object that are texts or absent; null if one is something else."""
    out = [found.get(n) for n in names] if isinstance(found, dict) else [0]
    return None if any(not isinstance(x, str | None) for x in out) else out


def judged(answer: str) -> tuple[str, object]:
    """(kind, parsed answer) of an answer's text; RETRY where the authorization failed."""
    try:
        found = json.loads(answer)
    except ValueError:
        return "UNEXPECTED", None
    error = found.get("error") if isinstance(found, dict) else None
    if not isinstance(found, dict) or error and not isinstance(error, dict):
        return "UNEXPECTED", None
    if not error:
        return "OK", found
    message = error.get("message") if isinstance(error.get("message"), str) else ""
    return {DENIED: "RETRY", MISSING: "NOT_FOUND", UNREACHED: "NETWORK" if "network" in message else "UNEXPECTED"}.get(error.get("code"), "UNEXPECTED"), None


class AnswersReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.service, self.folder = options.get("service", ""), options.get("path", "")
        if self.service not in SCHEMAS:
            raise ValueError(f"service is one of {', '.join(SCHEMAS)}")
        self.requests, self.requests_path = options.get("requests"), options.get("requests_path")
        self.wanted: dict[str, set] = {}

    def partitions(self) -> list[Asked]:
        if self.requests is not None:
            named = json.loads(self.requests)
            return [Asked({name: list(ids)}) for name, ids in named.items() if name in self.wanted.get("request", {name})]
        import pyarrow.dataset as ds

        store, base = _filesystem(self.requests_path)
        table = ds.dataset(base, filesystem=store, format="parquet", exclude_invalid_files=False)
        return [Asked({}, fragment.path, group.id) for fragment in table.get_fragments() for group in fragment.row_groups]

    def _asked(self, part: Asked) -> Iterator[tuple[str, list[str]]]:
        if not part.path:
            yield from part.requests.items()
            return
        import pyarrow.parquet as pq

        store, _ = _filesystem(self.requests_path)
        with store.open_input_file(part.path) as f:
            rows = pq.ParquetFile(f).read_row_group(part.group, ["request", "ids"])
        for name, ids in zip(rows["request"].to_pylist(), rows["ids"].to_pylist(), strict=True):
            if name in self.wanted.get("request", {name}):
                yield name, ids or []

    def _answer(self, store, base: str, name: str) -> tuple[str, object, str | None]:
        """(kind, parsed, text) of what was recorded for an id."""
        for tried in ("", ".retry"):
            try:
                with store.open_input_stream(f"{base}/{self.service}/{quote(name, safe='')}{tried}.json") as f:
                    text = f.read().decode("utf-8", "replace")
            except FileNotFoundError:
                return ("DENIED" if tried else "NOT_FOUND"), None, None
            except OSError:
                return "NETWORK", None, None
            kind, found = judged(text)
            if kind != "RETRY":
                return kind, found, text
        return "DENIED", None, None

    def _fields(self, kind: str, found: dict, text: str | None) -> tuple[str, list[tuple]]:
        """(kind, the rows' last columns) of an answer."""
        if self.service == "files":
            texts = _texts(found, "id", "title", "mimeType", "downloadUrl", "thumbnailLink") if kind == "OK" else None
            fine = texts is not None and None not in texts[:3]
            return (kind if fine or kind != "OK" else "UNEXPECTED"), [tuple(texts[1:]) if fine else (None,) * 4]
        if self.service == "folders":
            items = found.get("items") if kind == "OK" and found.get("kind", LISTING) == LISTING else None
            ids = [x.get("id") if isinstance(x, dict) else None for x in items] if isinstance(items, list) else None
            if ids is None or not all(isinstance(x, str) for x in ids):
                return (kind if kind != "OK" else "UNEXPECTED"), [(None, None)]
            return kind, list(enumerate(ids)) or [(None, None)]
        fine = kind == "OK" and isinstance(found.get("feed"), dict)
        status = {"OK": 200, "NOT_FOUND": MISSING, "NETWORK": None}.get(kind, 500)
        return (kind if fine or kind != "OK" else "UNEXPECTED"), [(status, text if kind == "OK" else None)]

    def read(self, part: Asked) -> Iterator[pa.RecordBatch]:
        store, base = _filesystem(self.folder)
        names = [f.split()[0] for f in SCHEMAS[self.service].split(", ")]
        kinds = {"int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
        schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in SCHEMAS[self.service].split(", ")])
        wanted = [(names.index(c), values) for c, values in self.wanted.items()]
        rows: list[tuple] = []
        for request, ids in self._asked(part):
            answers = [(name, *self._fields(*self._answer(store, base, name))) for name in ids]
            complete = all(kind == "OK" for _, kind, _ in answers)
            every = ((request, pos, name, kind, complete, *fields) for pos, (name, kind, last) in enumerate(answers) for fields in last)
            rows += (row for row in every if all(row[at] in values for at, values in wanted))
            while len(rows) >= ROWS:
                yield _batch(rows[:ROWS], schema)
                rows = rows[ROWS:]
        if rows:
            yield _batch(rows, schema)


class PushingReader(AnswersReader):
    """The reader that takes filters. Spark keeps one reader for each load(), so a frame of it may stand but once in a query."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        fields = {f.split()[0] for f in SCHEMAS[self.service].split(", ")} & PUSHED
        for f in filters:
            if isinstance(f, EqualTo | In) and len(f.attribute) == 1 and f.attribute[0] in fields:
                values = set(f.value) if isinstance(f, In) else {f.value}
                self.wanted[f.attribute[0]] = self.wanted.get(f.attribute[0], values) & values
            else:
                yield f


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class RecordedAnswers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recorded_answers"

    def schema(self) -> str:
        return SCHEMAS[AnswersReader(self.options).service]

    def reader(self, schema) -> AnswersReader:
        return (PushingReader if self.options.get("push", "false").lower() == "true" else AnswersReader)(self.options)


def answers(spark: SparkSession, folder: str, service: str, requests: dict[str, list[str]] | DataFrame, push: bool = False) -> DataFrame:
    """The recorded answers to requests: a few of them as a dictionary, or a table (request, ids), which is written to the shared folder.
    With push, Spark pushes filters into Python's data sources from then on, and the frame may stand but once in a query."""
    if push:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordedAnswers)
    reader = spark.read.format("recorded_answers").option("service", service).option("push", str(push).lower())
    if isinstance(requests, dict):
        return reader.option("requests", json.dumps(requests)).load(folder)
    path = shared_folder(spark, "requests")
    # few bytes are many answers to read, so they are dealt over as many files, and tasks, as a shuffle has
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    requests.select(F.col("request").cast("string"), F.col("ids").cast("array<string>")).repartition(parts).write.parquet(path)
    return reader.option("requests_path", path).load(folder)


def load_folders(spark: SparkSession, folder: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Albums and photographs of recorded folders, as services.folder_albums gives them; ids: folder_id.

    Listings come first, each whole, however long; then a folder's children, S.CHILDREN a request, and the folder itself are asked for
    metadata, and a folder is complete if all its requests are. Folders whose listing is not OK give no album."""
    asked = ids.select(F.col("folder_id").alias("request"), F.array("folder_id").alias("ids"))
    listed = answers(spark, folder, "folders", asked).where("kind = 'OK'")
    children = F.array_sort(F.collect_list(F.when(F.col("child_id").isNotNull(), F.struct("child_pos", "child_id"))))["child_id"]
    part = F.floor(F.coalesce("child_pos", F.lit(0)) / S.CHILDREN)
    batches = listed.groupBy("request", part.alias("part")).agg(children.alias("ids"), F.first("id").alias("own"))
    # the folder itself stands behind the first children
    batches = batches.select(F.concat_ws("/", F.col("part").cast("string"), "request").alias("request"), F.when(F.col("part") == 0, F.concat("ids", F.array("own"))).otherwise(F.col("ids")).alias("ids"))
    files = answers(spark, folder, "files", batches)
    at = F.substring_index("request", "/", 1)
    place = (at.cast("int") * (S.CHILDREN + 1) + F.col("pos")).alias("pos")
    files = kept(files.select(F.substr("request", F.length(at) + 2).alias("request"), place, *(c for c in files.columns if c not in ("request", "pos"))))  # used twice
    own = F.max(F.when(F.col("id") == F.col("request"), F.col("title")))
    albums = files.groupBy(F.col("request").alias("folder_id")).agg(F.coalesce(own, F.lit(S.UNKNOWN)).alias("name"), F.bool_and("complete").alias("complete"))
    inside = files.where(C.supported_mime(F.col("mime"))).where("id <> request").withColumnRenamed("request", "folder_id")
    photos = inside.join(albums.where("complete").select("folder_id"), "folder_id").select("folder_id", "pos", F.col("id").alias("photo_id"), "title", "mime", "download_url")
    return albums, S.in_title_order(photos)


def load_feeds(spark: SparkSession, folder: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Albums and photographs of recorded feeds, as services.feed_albums gives them; ids: album_id, name (given)."""
    asked = ids.select(F.col("album_id").alias("request"), F.array("album_id").alias("ids"))
    found = answers(spark, folder, "feeds", asked).select(F.col("request").alias("album_id"), "status", "answer")
    return S.feed_albums(ids.join(found, "album_id"))


def record(rows: DataFrame, folder: str) -> DataFrame:
    """Writes answers (service, id, answer) as a recording; returns service, id and bytes. A task that runs again writes the same files."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        store, base = _filesystem(folder)
        for batch in batches:
            sizes = []
            for service, name, answer in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                path = f"{base}/{service}/{quote(name, safe='')}.json"
                store.create_dir(f"{base}/{service}")
                with store.open_output_stream(draft := f"{path}.{uuid.uuid4().hex}.tmp") as out:
                    out.write(answer.encode())
                store.move(draft, path)
                sizes.append(len(answer.encode()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sizes, pa.int64())], ["service", "id", "bytes"])

    return rows.select("service", "id", "answer").mapInArrow(written, "service string, id string, bytes long")
