"""WARC: a deterministic sharded writer of web records, and the reader of its archives."""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import discard, fresh_dir, only, small_batches, stored
from millrace.llm.records import filesystem

#: Payloads of fewer bytes are never replaced by a revisit record.
MIN_REVISIT_BYTES = 1000
#: Payload bytes of a shard, about; compressed bytes after which a file is closed.
SHARD_BYTES, ROLL_BYTES = 24 << 20, 8 << 20
#: Key ranges that bytes are counted over, and the most shards, about; parts of a range that holds too much.
RANGES, SPLIT = 4096, 16
#: The date of all records, unless another is asked for: a run's clock would make two runs differ.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_BYTES = 1 << 20
MANIFEST = "shard int, number int, file string, n_records long, bytes long, sha256 string"


def _record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own; without a time stamp, so equal records are equal bytes."""
    head = [("WARC-Type", kind), ("WARC-Date", DATE), *fields, ("WARC-Block-Digest", f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(text.encode() + block + b"\r\n\r\n") + packer.flush()


def _uri(page_id: int | None, digest: str) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}:{digest}>"


def _header_value(text: str) -> str:
    """Line ends and other controls of a URL would end the header; they are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in text)


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record with the payload, or a revisit record with the headers alone where ``refers_to`` is given."""
    sha1 = hashlib.sha1(payload)
    fields = [("WARC-Record-ID", _uri(page_id, sha1.hexdigest()))]
    if url is not None:
        fields.append(("WARC-Target-URI", _header_value(url)))
    fields += [("WARC-Payload-Digest", f"sha1:{base64.b32encode(sha1.digest()).decode()}"), ("Content-Type", "application/http;msgtype=response")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        return _record("response", fields, http + payload)
    return _record("revisit", [*fields, ("WARC-Profile", PROFILE), ("WARC-Refers-To", _uri(refers_to, sha1.hexdigest()))], http)


class _Files:
    """Files of one shard, one after the other: written under a temporary name, moved to the final one when whole."""

    def __init__(self, store, folder: str, shard: int, roll: int):
        self.store, self.folder, self.shard, self.roll = store, folder, shard, roll
        self.number, self.out = 0, None

    def add(self, record: bytes) -> dict | None:
        """A row for the manifest where this record filled the file."""
        if self.out is None:
            self.name = f"{self.folder}/shard-{self.shard:06d}-{self.number:04d}.warc.gz"
            self.temporary = f"{self.folder}/_temporary-{TaskContext.get().taskAttemptId()}-{self.shard:06d}-{self.number:04d}"
            self.out, self.sha, self.size, self.rows = self.store.open_output_stream(self.temporary, compression=None), hashlib.sha256(), 0, 0
            self._put(_record("warcinfo", [("WARC-Record-ID", f"<urn:x-file:{self.shard}:{self.number}>"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        self._put(record)
        self.rows += 1
        return self.close() if self.size >= self.roll else None

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)

    def close(self) -> dict | None:
        if self.out is None:
            return None
        self.out.close()
        self.store.move(self.temporary, self.name)
        row = {"shard": self.shard, "number": self.number, "file": self.name, "n_records": self.rows, "bytes": self.size, "sha256": self.sha.hexdigest()}
        self.out, self.number = None, self.number + 1
        return row


def _write(batches: Iterator[pa.RecordBatch], folder: str, roll: int) -> Iterator[pa.RecordBatch]:
    store, path = filesystem(folder)
    store.create_dir(path, recursive=True)
    schema = pa.schema([("shard", pa.int32()), ("number", pa.int32()), ("file", pa.string()), ("n_records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])
    files, rows, told, holder = None, [], None, None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("shard", "page_id", "payload_digest", "url", "html", "refers_to")]
        for shard, page_id, payload_digest, url, html, refers_to in zip(*columns, strict=True):
            if refers_to is not None:  # a decision, which stands before the pages that it is about
                told, holder = (page_id, payload_digest), refers_to
                continue
            refers_to = holder if told == (page_id, payload_digest) else None
            if files is None or files.shard != shard:
                rows.append(files and files.close())
                files = _Files(store, path, shard, roll)
            rows.append(files.add(page_record(page_id, url, (html or "").encode(), refers_to)))
        if done := [r for r in rows if r]:
            yield pa.RecordBatch.from_pylist(done, schema)
        rows = []
    if files and (last := files.close()):
        yield pa.RecordBatch.from_pylist([last], schema)


def revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, payload_digest, refers_to) of the pages whose payload a larger page_id has too."""
    told = pages.select("page_id", F.octet_length("html").alias("n"), F.sha1("html").alias("payload_digest")).filter(F.col("n") >= min_bytes)
    holders = told.groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("_least")).filter("_least < refers_to").drop("_least")
    return told.join(holders, "payload_digest").filter("page_id < refers_to").select("page_id", "payload_digest", "refers_to").distinct()


def _place(bounds: list[int], block: int = 64) -> Column:
    """The number of the last of the ascending ``bounds`` that page_id reaches, found by its block, then within the block."""
    blocks = [bounds[k : k + block] for k in range(0, len(bounds), block)]
    reached = lambda c: F.size(F.filter(c, lambda x: x <= F.col("page_id")))
    outer = F.greatest(reached(F.from_json(F.lit(str([x[0] for x in blocks])), "array<bigint>")), F.lit(1)) - 1
    return outer * block + F.greatest(reached(F.get(F.from_json(F.lit(str(blocks)), "array<array<bigint>>"), outer)), F.lit(1)) - 1


def shard_bounds(pages: DataFrame, shard_bytes: int) -> list[int]:
    """Ascending page_ids, each the first of a shard: consecutive ranges, cut where their bytes reach ``shard_bytes``.

    Bytes are counted over RANGES equal ranges of page_id; a range that holds more than a quarter of a shard is split into
    SPLIT of its own span, again and again, until it fits or is one page_id. So ids may be dense, sparse or far off. Shards grow
    beyond ``shard_bytes`` where there would be more than RANGES of them, so at most 4 * RANGES ranges are split at a time, and the
    driver holds SPLIT counts of each. The cuts depend on the rows alone, not on partitions or a sample.
    """
    sizes = stored(pages.filter("page_id is not null").groupBy("page_id").agg(F.sum(F.octet_length("html") + 500).alias("b")), "page-sizes")
    whole = sizes.agg(F.sum("b").alias("b"), F.min("page_id").alias("lo"), F.max("page_id").alias("hi")).first()
    limit = max(shard_bytes, -(-(whole["b"] or 0) // RANGES))
    small = limit / 4
    fits, wide, parts = [], [(whole["lo"], whole["hi"])] if whole["b"] else [], RANGES
    while wide:
        number = _place([lo for lo, _ in wide])
        spans = F.from_json(F.lit(json.dumps([[lo, hi, -(-(hi - lo + 1) // parts)] for lo, hi in wide])), "array<array<decimal(20,0)>>")
        span, place = F.get(spans, F.col("n")), F.col("page_id").cast("decimal(20,0)")
        inside = sizes.withColumn("n", number).withColumn("s", span).filter((place >= F.col("s")[0]) & (place <= F.col("s")[1]))
        part = inside.withColumn("part", F.expr("(cast(page_id as decimal(20,0)) - s[0]) div s[2]"))
        found = part.groupBy("n", "part").agg(F.sum("b").alias("b"), F.min("page_id").alias("lo"), F.max("page_id").alias("hi")).collect()
        fits += [(r["lo"], r["b"]) for r in found if r["b"] <= small or r["lo"] == r["hi"]]
        wide, parts = sorted((r["lo"], r["hi"]) for r in found if r["b"] > small and r["lo"] < r["hi"]), SPLIT
    discard(sizes)
    bounds, held = [], limit
    for lo, size in sorted(fits):
        if held >= limit:
            bounds.append(lo)
            held = 0
        held += size
    return bounds or [0]


def write_archives(pages: DataFrame, folder: str | None = None, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> tuple[DataFrame, str]:
    """Writes a record per row of ``pages`` (page_id, url, html); returns the manifest of the files, and the folder.

    Records stand in order of shard and page_id; a shard's file is closed at the record that brings it to ``roll_bytes``
    compressed, and each has a warcinfo record of its own. Headers and digests are made anew. Of equal payloads of 1000 bytes or more the
    largest page_id is the response, others are revisits of it. A task writes under a temporary name of its attempt and moves
    the whole file; equal rows give equal bytes, so an attempt that is run again moves the same file. Files count only where the
    manifest, which Spark commits, names them.

    Null html: an empty payload. Null url: no target header. A null page_id is a response in the first shard. Repeated rows are records of their own, and
    where they have the largest page_id of a payload all are responses. No pages: no file. Extra columns are ignored.
    """
    spark = pages.sparkSession
    small_batches(spark)
    folder = folder or fresh_dir(spark, "warc")
    base = only(pages, page_id="long", url="string", html="string").withColumn("html", F.coalesce("html", F.lit("")))
    # Decisions travel with the pages, in one shuffle, and are sorted before the page that they are about.
    records = base.withColumn("payload_digest", F.sha1("html")).withColumn("refers_to", F.lit(None).cast("long"))
    both = records.unionByName(revisits(base), allowMissingColumns=True)
    bounds = shard_bounds(base, shard_bytes)
    sharded = both.withColumn("shard", _place(bounds))
    # Twice as many ranges as shards: the bounds that Spark samples then seldom leave two shards to one task.
    ordered = sharded.repartitionByRange(2 * len(bounds), "shard").sortWithinPartitions("shard", "page_id", "payload_digest", F.col("refers_to").isNull(), "url")
    ordered = ordered.select("shard", "page_id", "payload_digest", "url", "html", "refers_to")
    return stored(ordered.mapInArrow(lambda b: _write(b, folder, roll_bytes), MANIFEST), "warc-manifest"), folder


def _members(stream) -> Iterator[bytes]:
    """The records of a file, one gzip member after the other; memory holds one of them."""
    unpack, parts = zlib.decompressobj(31), []
    while data := stream.read(READ_BYTES):
        while data:
            parts.append(unpack.decompress(data))
            data = unpack.unused_data
            if unpack.eof:
                yield b"".join(parts)
                unpack, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the archive ends within a record")


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}


def parse_record(record: bytes) -> dict | None:
    """A page's row from its record, digests compared; None for other records."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = _fields(head)
    if fields["warc-type"] not in ("response", "revisit"):
        return None
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    of = lambda name: fields[name].strip("<>").split(":")[2]
    digest = base64.b32decode(fields["warc-payload-digest"].partition(":")[2])
    block_digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
    revisit = fields["warc-type"] == "revisit"
    if fields["warc-block-digest"] != f"sha1:{block_digest}" or not revisit and hashlib.sha1(payload).digest() != digest:
        raise ValueError(f"a digest of {fields['warc-record-id']} does not match its bytes")
    page_id, refers_to = of("warc-record-id"), of("warc-refers-to") if revisit else ""
    return {
        "page_id": int(page_id) if page_id else None, "url": fields.get("warc-target-uri"), "payload_bytes": int(_fields(http)["content-length"]),
        "payload_digest": digest.hex(), "record_type": fields["warc-type"], "refers_to": int(refers_to) if refers_to else None, "payload": None if revisit else payload,
    }


def _read(batches: Iterator[pa.RecordBatch], folder: str, payloads: bool) -> Iterator[pa.RecordBatch]:
    store, _ = filesystem(folder)
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    schema = pa.schema([*kinds, ("payload", pa.binary())] if payloads else kinds)
    for batch in batches:
        for file in batch.column("file").to_pylist():
            with store.open_input_stream(file, compression=None) as stream:
                rows = []
                for row in filter(None, map(parse_record, _members(stream))):
                    rows.append(row)
                    if len(rows) == 64:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)


def read_archives(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """One row per page record: page_id, url, payload_bytes and payload_digest (of the full payload, for revisits too),
    record_type, refers_to, and payload (null for revisits), which can be left out."""
    files = max(1, manifest.count())
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return manifest.select("shard", "number", "file").repartitionByRange(files, "shard", "number").mapInArrow(lambda b: _read(b, folder, payloads), schema + ", payload binary" * payloads)


def digest(pages: DataFrame) -> DataFrame:
    """The query's columns, from the archives read back."""
    return read_archives(*write_archives(pages), payloads=False).drop("url")


ORACLE = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
     m AS (SELECT payload_digest, max(page_id) AS holder FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN page_id < holder THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < holder THEN holder END AS refers_to
FROM p LEFT JOIN m ON p.payload_digest = m.payload_digest AND payload_bytes >= 1000
"""
