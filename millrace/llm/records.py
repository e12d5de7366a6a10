"""Token-ID output: length-delimited binary records with masked checksums, and an offset index for shuffled reads.

A record is its payload's length (unsigned 64-bit), the masked CRC-32C of those 8 bytes, the payload, and the masked CRC-32C
of the payload; all little-endian. A payload is the doc_id (signed 64-bit; the least value where it is null), the width of
an id in bytes (unsigned 32-bit) and the ids (unsigned 16-bit where all of the record's ids fit, else 32-bit). The index of a file has a row of four signed 64-bit numbers for each record: doc_id, offset of the record
in the file, its length with the frame, its ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import fresh_dir, only, small_batches, stored
from millrace.llm.crc32c import checksums, masked
from millrace.llm.tokens import encode_batches, vocabulary_path

#: In a record the word behind the id holds the width of its tokens, and this flag where there is no id.
NULL_ID = 1 << 8
FRAME = 16
#: Bytes of a file that a reader holds at once, if no record is longer.
READ_BYTES = 4 << 20
MANIFEST = "part int, file string, index string, n_records long, n_ids long, bytes long"


def filesystem(uri: str):
    """The file system of a folder's address and the path in it; any store that pyarrow reads will do."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def frame(doc_ids: list[int | None], ids: list[np.ndarray]) -> tuple[bytes, np.ndarray]:
    """Records end to end, and the length of each."""
    payloads = []
    for d, x in zip(doc_ids, ids, strict=True):
        width = 2 if not len(x) or x.max() < 1 << 16 else 4
        payloads.append(np.int64(d or 0).tobytes() + np.uint32(width | (NULL_ID if d is None else 0)).tobytes() + x.astype(f"<u{width}").tobytes())
    sizes = np.array([len(p) for p in payloads], np.int64)
    heads = sizes.astype("<u8")
    head_crc = masked(checksums(heads.view(np.uint8), np.arange(len(sizes) + 1) * 8)).astype("<u4")
    body_crc = masked(checksums(np.frombuffer(b"".join(payloads), np.uint8), np.concatenate([[0], np.cumsum(sizes)]))).astype("<u4")
    return b"".join(heads[i].tobytes() + head_crc[i].tobytes() + p + body_crc[i].tobytes() for i, p in enumerate(payloads)), sizes + FRAME


def unframe(data: bytes) -> tuple[list[int], list[np.ndarray], int]:
    """doc_ids and ids of the whole records at the start of ``data``, checksums compared, and the bytes they take."""
    at, spans = 0, []
    while at + 12 <= len(data):
        size = int.from_bytes(data[at : at + 8], "little")
        if at + FRAME + size > len(data):
            break
        spans.append((at, size))
        at += FRAME + size
    if not spans:
        return [], [], 0
    raw = np.frombuffer(data, np.uint8)
    heads = b"".join(data[a : a + 8] for a, _ in spans)
    bodies = b"".join(data[a + 12 : a + 12 + n] for a, n in spans)
    bounds = np.concatenate([[0], np.cumsum([n for _, n in spans])])
    head_crc = masked(checksums(np.frombuffer(heads, np.uint8), np.arange(len(spans) + 1) * 8))
    body_crc = masked(checksums(np.frombuffer(bodies, np.uint8), bounds))
    told = lambda places: np.array([int.from_bytes(raw[p : p + 4].tobytes(), "little") for p in places], np.uint32)
    if not (np.array_equal(head_crc, told([a + 8 for a, _ in spans])) and np.array_equal(body_crc, told([a + 12 + n for a, n in spans]))):
        raise ValueError("a record's checksum does not match its bytes")
    doc_ids = [None if data[a + 21] else int.from_bytes(data[a + 12 : a + 20], "little", signed=True) for a, _ in spans]
    widths = [data[a + 20] for a, _ in spans]
    return doc_ids, [np.frombuffer(data, f"<u{w}", (n - 12) // w, a + 24).astype("<u4") for w, (a, n) in zip(widths, spans, strict=True)], at


def _write(batches: Iterator[pa.RecordBatch], folder: str, vocabulary: str) -> Iterator[pa.RecordBatch]:
    store, path = filesystem(folder)
    context = TaskContext.get()
    # Each attempt writes files of its own; the manifest, which Spark commits, names those of the attempt that counts.
    name = f"{path}/part-{context.partitionId():06d}-{context.taskAttemptId()}"
    index, n_records, n_ids, offset, out = [], 0, 0, 0, None
    for batch, ids in encode_batches(batches, vocabulary):
        if out is None:
            store.create_dir(path, recursive=True)
            out = store.open_output_stream(f"{name}.records")
        doc_ids = batch.column("doc_id").to_pylist()
        data, sizes = frame(doc_ids, ids)
        out.write(data)
        places = offset + np.concatenate([[0], np.cumsum(sizes)])
        counts = np.array([len(x) for x in ids], np.int64)
        index.append(np.stack([np.array([d or 0 for d in doc_ids], np.int64), places[:-1], sizes, counts], axis=1))
        n_records, n_ids, offset = n_records + len(ids), n_ids + int(counts.sum()), int(places[-1])
    if out is not None:
        out.close()
        with store.open_output_stream(f"{name}.index") as rows:
            for part in index:
                rows.write(part.astype("<i8").tobytes())
        row = [[context.partitionId()], [f"{name}.records"], [f"{name}.index"], [n_records], [n_ids], [offset]]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["part", "file", "index", "n_records", "n_ids", "bytes"])


def write_records(docs: DataFrame, folder: str | None = None, vocabulary: str | None = None) -> tuple[DataFrame, str]:
    """Encodes ``docs`` (doc_id, text) and writes them in ascending doc_id order; returns the manifest and the folder.

    Rows are range-partitioned by doc_id and sorted, one file for each partition; files are in doc_id order by ``part``. Null
    texts are empty and have the end id alone. A null doc_id comes first (0 in the index, a flag in the record). Rows that repeat a doc_id are records of their own.
    No documents: no file and an empty manifest. A task holds one Arrow batch and the index of its file.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or fresh_dir(spark, "records")
    path = vocabulary or vocabulary_path()
    ordered = only(docs, doc_id="long", text="string").repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id")
    return stored(ordered.mapInArrow(lambda b: _write(b, folder, path), MANIFEST), "records-manifest"), folder


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    store, _ = filesystem(folder)
    for batch in batches:
        for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
            with store.open_input_stream(file) as stream:
                data = b""
                while more := stream.read(READ_BYTES):
                    data += more
                    doc_ids, ids, used = unframe(data)
                    if not used:
                        continue
                    data = data[used:]
                    counts = np.array([len(x) for x in ids], np.int64)
                    starts = start + np.concatenate([[0], np.cumsum(counts)])
                    start = int(starts[-1])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc_ids, pa.int64()), pa.array(starts[:-1]), pa.array([x.tobytes() for x in ids], pa.binary())],
                        ["doc_id", "start", "ids"],
                    )
                if data:
                    raise ValueError(f"{file} ends within a record")


def read_records(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per record: doc_id, start (ids of all documents before it) and ids (their bytes). Files are read in pieces."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over files, not documents
    placed = manifest.select("part", "file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long").alias("start"))
    files = max(1, manifest.count())
    return placed.repartitionByRange(files, "part").mapInArrow(lambda b: _read(b, folder), "doc_id long, start long, ids binary")


def read_at(folder: str, file: str, index: str, rows: list[int]) -> list[tuple[int | None, np.ndarray]]:
    """Some records of a file, by their numbers in its index, in the order asked for."""
    store, _ = filesystem(folder)
    with store.open_input_file(index) as held, store.open_input_file(file) as data:
        out = []
        for row in rows:
            _, offset, size, _ = np.frombuffer(held.read_at(32, 32 * row), "<i8").tolist()
            doc_ids, ids, _ = unframe(data.read_at(size, offset))
            out.append((doc_ids[0], ids[0]))
        return out


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns, from the files read back."""
    read = read_records(*write_records(docs))
    return read.select("doc_id", "start", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
