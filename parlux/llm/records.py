"""Token ids in files of length-delimited binary records, with a separate offset index.

Shard NNNNN.records is a run of frames: payload length (unsigned 64-bit, little-endian), masked CRC-32 of those eight bytes (unsigned
32-bit), the payload, masked CRC-32 of the payload. A payload is one document: doc_id (signed 64-bit), whether it has one (a byte),
the width of an id (a byte: 2 or 4), and the ids. Shard NNNNN.index has, for each frame in order, its place and its length in the
shard (two unsigned 64-bit numbers), so that records can be read in any order. Masking turns a checksum by 15 bits and adds a
constant, so that a checksum over data that hold checksums stays sound.

Shards are ranges of the order by doc_id (null first; equal ids by a hash of the text, then by text), and a shard ends with its
partition. The ranges' bounds are sampled from ids and hashes alone: no text goes to the driver, but all travel once, as a global order asks.
Rows that repeat both id and text are one place of that order and so lie in one shard. Files are written under
another name and renamed when they are complete, so a task that is run again replaces its own file by an equal one.

Defined results: a null or empty text is a record of the end id alone; a null doc_id is kept as absent; repeated rows are records
each; an empty table gives no records; a text of any length is one record; further columns do not matter."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlux.llm._durable import durable, shared_dir, tidied
from parlux.llm._tokens import byte_bpe, forget

END_ID = 2
#: The layouts of a frame's head and of a payload's head.
HEAD, DOC = "<QI", "<qBB"
#: Bytes that a reader takes at a time.
BLOCK = 8 << 20


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return size + struct.pack("<I", masked(zlib.crc32(size))) + payload + struct.pack("<I", masked(zlib.crc32(payload)))


def unframe(data: bytes | memoryview) -> bytes:
    """The payload of one frame; ValueError if a checksum or the length is wrong."""
    size, check = struct.unpack_from(HEAD, data)
    end = struct.calcsize(HEAD) + size
    if masked(zlib.crc32(data[:8])) != check or len(data) != end + 4:
        raise ValueError("the frame's length is damaged")
    payload = bytes(data[struct.calcsize(HEAD) : end])
    if struct.unpack_from("<I", data, end)[0] != masked(zlib.crc32(payload)):
        raise ValueError("the record is damaged")
    return payload


def _write(path: str, out: str, end_id: int):
    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        store, base = arrow_fs.FileSystem.from_uri(out)
        task = TaskContext.get()
        shard = task.partitionId()
        name, attempt = f"{base}/{shard:05d}", f"{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        ends: list[int] = []
        tokens = place = 0
        stream = None
        kind = "<u2" if bpe.width == 2 and end_id < 1 << 16 else "<u4"
        for batch in batches:
            for lo, hi, ids, cuts in bpe.texts(batch.column(1)):
                docs = batch.column(0).slice(lo, hi - lo).to_pylist()
                run = np.insert(ids, cuts[1:], end_id).astype(kind).tobytes()
                width = int(kind[-1])
                cuts = (cuts + np.arange(len(cuts))) * width
                parts = []
                for doc, a, b in zip(docs, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    parts.append(frame(struct.pack(DOC, doc or 0, doc is not None, width) + run[a:b]))
                    place += len(parts[-1])
                    ends.append(place)
                stream = stream or store.open_output_stream(f"{name}.{attempt}.tmp")
                stream.write(b"".join(parts))
                tokens += len(run) // width
        if stream is not None:
            stream.close()
            at = np.array([0, *ends], "<u8")
            with store.open_output_stream(f"{name}.index.{attempt}.tmp") as index:
                index.write(np.stack([at[:-1], at[1:] - at[:-1]], 1).tobytes())
            store.move(f"{name}.{attempt}.tmp", f"{name}.records")
            store.move(f"{name}.index.{attempt}.tmp", f"{name}.index")
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([f"{name}.records"]), pa.array([len(ends)], pa.int64()), pa.array([tokens], pa.int64()), pa.array([place], pa.int64())], ["shard", "path", "records", "tokens", "bytes"])

    return written


def write_records(docs: DataFrame, tokenizer_path: str, out: str, end_id: int = END_ID, shards: int | None = None) -> DataFrame:
    """Writes docs (doc_id, text) as records in the folder out, which all executors share (any file system that pyarrow opens by URI).

    Returns the manifest, one row a shard: shard, path, records, tokens, bytes, and start (the tokens of all shards before it)."""
    store, base = arrow_fs.FileSystem.from_uri(out)
    store.create_dir(base)
    shards = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("_hash")]
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("_hash", F.xxhash64("text"))
    placed = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order, F.col("text").asc_nulls_first()).drop("_hash")
    manifest = durable(placed.mapInArrow(tidied(_write(tokenizer_path, out, end_id), forget), "shard int, path string, records long, tokens long, bytes long"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    return manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def _read(out: str, digest: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = arrow_fs.FileSystem.from_uri(out)
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with store.open_input_stream(path.removesuffix("records") + "index") as f:
                    index = np.frombuffer(f.read(), "<u8").reshape(-1, 2).astype(np.int64)
                with store.open_input_file(path) as f:
                    lo = 0
                    while lo < len(index):
                        hi = max(lo + 1, int(np.searchsorted(index[:, 0], index[lo, 0] + BLOCK)))
                        first = int(index[lo, 0])
                        block = memoryview(f.read_at(int(index[hi - 1].sum()) - first, first))
                        columns: list[list] = [[], [], [], []]
                        for at, size in (index[lo:hi] - [first, 0]).tolist():
                            payload = unframe(block[at : at + size])
                            doc, has, width = struct.unpack_from(DOC, payload)
                            ids = np.frombuffer(payload, f"<u{width}", offset=struct.calcsize(DOC))
                            for column, x in zip(columns, (doc if has else None, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()) if digest else ids.astype(np.int64)), strict=True):
                                column.append(x)
                            start += len(ids)
                        kinds = [pa.int64()] * 3 + [pa.int64() if digest else pa.list_(pa.int64())]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])
                        lo = hi

    return read


def read_records(manifest: DataFrame, out: str, digest: bool = False) -> DataFrame:
    """The records of a manifest, every checksum verified: doc_id, start (tokens of all records before it), n_tokens, and ids, or
    with digest the CRC-32 of the ids as unsigned 32-bit little-endian numbers. Shards are read in parallel, each as a stream."""
    last = "ids_crc32 long" if digest else "ids array<long>"
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path", "start").repartition(parts).mapInArrow(tidied(_read(out, digest)), f"doc_id long, start long, n_tokens long, {last}")


def op10_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the records, reads them back into a durable result, and removes the files."""
    out = f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    result = durable(read_records(write_records(docs, public_tokenizers.path("byte_bpe_50k.json"), out), out, digest=True))
    store, base = arrow_fs.FileSystem.from_uri(out)
    store.delete_dir(base)
    return result
