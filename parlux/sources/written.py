"""A data sink for files that are made of parts: rows (doc, path, part), sorted by doc and path in each partition, become one file a doc.

    spark.dataSource.register(ContainerFiles)
    parts.write.format("container_files").mode("append").save("file:///videos")

Parts go to their file as they come, so a task's memory does not depend on the size of a file. A task writes into a folder of its own; its
folder is put in place, by one rename, once all tasks are done, and drafts go away if any of them fails: a job that fails leaves no
file, nor does a task that ran twice. As a stream's sink, a batch's folders bear its number, and a batch that comes again changes
nothing. Files lie in <folder>/<job or batch>-<partition>/<doc><suffix> (docs are percent-encoded); options: suffix (.webm), name
(of the job; what a job of that name has put in place already stays).

A doc's rows are to be in one partition, together; a doc that begins again after another is an error. Null docs and parts are errors."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage

DRAFTS = "_drafts"
SCHEMA = "doc string, path array<int>, part binary"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


@dataclass
class Written(WriterCommitMessage):
    """A task's folder of drafts, its partition, files and bytes."""

    draft: str
    partition: int
    files: int
    bytes: int


class _Writer:
    def __init__(self, folder: str, options: dict[str, str]):
        self.folder, self.suffix, self.job = folder, options.get("suffix", ".webm"), uuid.uuid4().hex
        self.name = options.get("name", self.job)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, base = _filesystem(self.folder)
        task = TaskContext.get()
        draft = f"{base}/{DRAFTS}/{self.job}/{task.partitionId():05d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        stream, at, done, size = None, None, set(), 0
        try:
            for batch in iterator:
                docs, parts = (batch.column(batch.schema.get_field_index(c)) for c in ("doc", "part"))
                for doc, part in zip(docs.to_pylist(), parts, strict=True):
                    if doc is None or not part.is_valid:
                        raise ValueError("a part without a document or content")
                    if doc != at:
                        if doc in done:
                            raise ValueError(f"the parts of {doc} are not together")
                        if stream is not None:
                            stream.close()
                        elif not done:
                            store.create_dir(draft)
                        stream, at = store.open_output_stream(f"{draft}/{quote(doc, safe='')}{self.suffix}"), doc
                        done.add(doc)
                    stream.write(part.as_buffer())
                    size += len(part.as_buffer())
        finally:
            if stream is not None:
                stream.close()
        return Written(draft, task.partitionId(), len(done), size)

    def _commit(self, messages: list[Written | None], name: str) -> None:
        from pyarrow import fs

        store, base = _filesystem(self.folder)
        for m in messages:
            if m is not None and m.files:
                place = f"{base}/{name}-{m.partition:05d}"
                if store.get_file_info(place).type == fs.FileType.NotFound:
                    store.move(m.draft, place)
        self._forget(store, base, messages)

    def _abort(self, messages: list[Written | None]) -> None:
        self._forget(*_filesystem(self.folder), messages)

    def _forget(self, store, base: str, messages: list[Written | None]) -> None:
        """Drafts of this job (a stream's tasks may have another number than what commits them) go, and their folder, if it is empty."""
        from pyarrow import fs

        drafts = f"{base}/{DRAFTS}"
        for folder in {f"{drafts}/{self.job}", *(m.draft.rsplit("/", 1)[0] for m in messages if m is not None)}:
            if store.get_file_info(folder).type != fs.FileType.NotFound:
                store.delete_dir(folder)
        if store.get_file_info(drafts).type != fs.FileType.NotFound and not store.get_file_info(fs.FileSelector(drafts)):
            store.delete_dir(drafts)


class FilesWriter(_Writer, DataSourceArrowWriter):
    def commit(self, messages: list[Written | None]) -> None:
        self._commit(messages, self.name)

    def abort(self, messages: list[Written | None]) -> None:
        self._abort(messages)


class FilesStreamWriter(_Writer, DataSourceStreamArrowWriter):
    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self._commit(messages, f"batch-{batchId}")

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self._abort(messages)


class ContainerFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "container_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        if overwrite:
            raise ValueError("files are only added; use the mode append")
        return FilesWriter(self.options["path"], self.options)

    def streamWriter(self, schema, overwrite: bool) -> FilesStreamWriter:
        return FilesStreamWriter(self.options["path"], self.options)


def by_document(parts: DataFrame) -> DataFrame:
    """parts (doc, path, part) as the sink takes them: a document's rows in one task, in order."""
    return parts.select(parts["doc"].cast("string").alias("doc"), "path", "part").repartition("doc").sortWithinPartitions("doc", "path")


def write_parts(parts: DataFrame, folder: str, suffix: str = ".webm") -> None:
    """Writes parts (doc, path, part) as files, dealt to tasks by doc and sorted."""
    parts.sparkSession.dataSource.register(ContainerFiles)
    by_document(parts).write.format("container_files").option("suffix", suffix).mode("append").save(folder)
