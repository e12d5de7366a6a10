"""A data source of PCM audio: ``spark.read.format("wav")`` reads byte ranges of long files in several tasks, and writes recordings.

``register(spark)`` makes it known. Rows are blocks of samples, one channel, as the operators of
``millrace.operators.frames`` take them: path, sr, n, start, y, status. What is no readable PCM file is one row with its reason.
"""

from __future__ import annotations

import os
import struct
import uuid
import wave
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith, WriterCommitMessage

SCHEMA = "path string, sr int, n long, start long, y array<float>, status string"
ARROW = pa.schema([("path", pa.string()), ("sr", pa.int32()), ("n", pa.int64()), ("start", pa.int64()), ("y", pa.list_(pa.float32())), ("status", pa.string())])
#: What a file counts for beside its bytes, as a share of a partition: no task opens more than 512.
OPEN = 1 / 512
#: PCM, and the extensible form that names it in a sub-format.
PCM, EXTENSIBLE = 1, 0xFFFE


def filesystem(uri: str):
    """The file system of an address and the path in it; a bare path is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def mono(raw: bytes, width: int, channels: int) -> np.ndarray:
    """Samples of whole PCM frames of 1 to 4 bytes a channel, channels averaged, between -1 and 1."""
    if width == 1:
        y = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    elif width == 3:
        parts = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        y = ((parts[:, 0] << 8 | parts[:, 1] << 16 | parts[:, 2] << 24) >> 8) / float(1 << 23)
    else:
        y = np.frombuffer(raw, f"<i{width}").astype(float) / float(1 << (8 * width - 1))
    return y.reshape(-1, channels).mean(axis=1)


@dataclass(frozen=True)
class Header:
    sr: int
    channels: int
    width: int
    data: int  # first byte of the samples
    n: int  # samples of a channel


def header(file, size: int) -> Header:
    """The header of an open file of ``size`` bytes: chunks are walked by their lengths, whatever comes before the samples."""
    start = file.read(12)
    if len(start) < 12 or start[:4] != b"RIFF" or start[8:12] != b"WAVE":
        raise ValueError("no RIFF/WAVE header")
    at, kind = 12, None
    while at + 8 <= size:
        file.seek(at)
        name, length = struct.unpack("<4sI", file.read(8))
        if name == b"fmt ":
            fmt = file.read(min(length, 40))
            if len(fmt) < 16:
                raise ValueError("short format chunk")
            tag, channels, sr, _, _, bits = struct.unpack("<HHIIHH", fmt[:16])
            tag = struct.unpack("<H", fmt[24:26])[0] if tag == EXTENSIBLE and len(fmt) >= 26 else tag
            if tag != PCM or not channels or not sr or bits not in (8, 16, 24, 32):
                raise ValueError(f"not PCM of 8 to 32 bits (format {tag}, {bits} bits, {channels} channels, rate {sr})")
            kind = (sr, channels, bits // 8)
        elif name == b"data":
            if kind is None:
                raise ValueError("samples before a format chunk")
            held = min(length, size - at - 8)  # a file cut short has what it has
            n = held // (kind[1] * kind[2])
            if not n:
                raise ValueError("no samples")
            return Header(*kind, at + 8, n)
        at += 8 + length + length % 2
    raise ValueError("no samples")


class Ranges(InputPartition):
    """Byte ranges of files: (path, size, from, to)."""

    def __init__(self, ranges: list[tuple[str, int, int, int]]):
        self.ranges = ranges


class WavReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("the source wav needs a path")
        self.root = options["path"]
        self.bytes = int(options.get("partitionbytes", options.get("partitionBytes", 32 << 20)))
        self.block = int(options.get("blocksamples", options.get("blockSamples", 1 << 16)))
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  the interface's name
        """Conditions on the path choose files before any is opened; others stay with Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith)) and f.attribute == ("path",):
                self.tests.append(f)
            else:
                yield f

    def _wanted(self, path: str) -> bool:
        return all(path == f.value if isinstance(f, EqualTo) else path in f.value if isinstance(f, In) else path.startswith(f.value) if isinstance(f, StringStartsWith) else path.endswith(f.value) for f in self.tests)

    def partitions(self) -> list[Ranges]:
        """Long files are cut into ranges, short ones share a partition, where each also counts for OPEN of it, as opening takes
        its time; only names and sizes are listed here."""
        from pyarrow import fs

        store, base = filesystem(self.root)
        at = store.get_file_info(base)
        if at.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        files = [at] if at.type == fs.FileType.File else store.get_file_info(fs.FileSelector(base, recursive=True))
        out, room = [], 0
        for f in sorted((f for f in files if f.type == fs.FileType.File and f.path.lower().endswith(".wav") and self._wanted(f.path)), key=lambda f: f.path):
            for a in range(0, max(1, f.size), self.bytes):
                z = min(f.size, a + self.bytes)
                taken = z - a + int(self.bytes * OPEN)
                if not out or room < taken:
                    out.append([])
                    room = self.bytes
                out[-1].append((f.path, f.size, a, z))
                room -= taken
        return [Ranges(r) for r in out] or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        """Blocks of short files go out together, as many as one of 65,536 samples holds."""
        held, size = [], 0
        for r in self._blocks(partition):
            held.append(r)
            size += len(r["y"]) if r["y"] is not None else 0
            if size >= 1 << 16 or len(held) >= 1024:
                yield pa.RecordBatch.from_pylist(held, ARROW) if len(held) > 1 else self._one(held[0])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, ARROW)

    def _one(self, r: dict) -> pa.RecordBatch:
        """A block without its samples as Python numbers."""
        y = pa.ListArray.from_arrays(pa.array([0, len(r["y"])], pa.int32()), pa.array(r["y"]))
        return pa.RecordBatch.from_arrays([y if c.name == "y" else pa.array([r[c.name]], c.type) for c in ARROW], schema=ARROW)

    def _blocks(self, partition: Ranges) -> Iterator[dict]:
        store, _ = filesystem(self.root)
        row = lambda *v: dict(zip(ARROW.names, v, strict=True))
        for path, size, a, z in partition.ranges:
            try:
                with store.open_input_file(path) as file:
                    h = header(file, size)
                    frame = h.channels * h.width
                    # A sample belongs to the range that its first byte lies in.
                    first, last = (min(h.n, max(0, -(-(x - h.data) // frame))) for x in (a, z))
                    for i in range(first, last, self.block):
                        n = min(self.block, last - i)
                        file.seek(h.data + i * frame)
                        y = mono(file.read(n * frame), h.width, h.channels).astype(np.float32)
                        yield row(path, h.sr, h.n, i, y, "ok")
            except (OSError, ValueError) as error:
                if a == 0:
                    yield row(path, None, None, None, None, f"err: {error}")


class WavWriter(DataSourceWriter):
    """Writes rows (name, sr, y) as files of 16 bits, one channel: name.wav below the folder. Values beyond -1 and 1 are clipped.

    A file is written under a name of its own and then moved: readers see it whole or not at all, and a task run again
    puts the same file in its place.
    """

    def __init__(self, options: dict[str, str]):
        self.root = options["path"]

    def write(self, rows: Iterator) -> WriterCommitMessage:
        store, base = filesystem(self.root)
        store.create_dir(base, recursive=True)
        for r in rows:
            target, temporary = f"{base}/{r['name']}.wav", f"{base}/.{uuid.uuid4().hex}.tmp"
            with store.open_output_stream(temporary) as out, wave.open(out, "wb") as w:
                w.setnchannels(1)
                w.setsampwidth(2)
                w.setframerate(r["sr"])
                w.setnframes(len(r["y"]))
                w.writeframesraw(np.rint(np.clip(np.array(r["y"], float), -1, 1) * 32767).astype("<i2").tobytes())
            store.move(temporary, target)
        return WriterCommitMessage()


class WavSource(DataSource):
    """Options: ``path``; ``partitionBytes`` of a task (32 MB), ``blockSamples`` of a row (65,536)."""

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WavReader:
        return WavReader(self.options)

    def writer(self, schema, overwrite: bool) -> WavWriter:
        return WavWriter(self.options)


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, with conditions pushed down, which Spark wants to be asked for."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WavSource)
