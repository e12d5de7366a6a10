"""Best-fit packing: the plan is made over a histogram of lengths, and pieces take its slots by their rank within a length."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import only, small_batches, stored
from millrace.llm.tokens import encode_batches, vocabulary_path

CAPACITY = 2048


def piece_bounds(n: int, capacity: int) -> list[int]:
    """Where a document of ``n`` ids is cut: into full pieces, of which only the first may be shorter."""
    head = n % capacity or min(n, capacity)
    return [0, *range(head, n + 1, capacity)]


def _pieces(batches: Iterator[pa.RecordBatch], vocabulary: str, capacity: int) -> Iterator[pa.RecordBatch]:
    for batch, all_ids in encode_batches(batches, vocabulary):
        rows = []
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), all_ids, strict=True):
            cuts = piece_bounds(len(ids), capacity)
            rows += [(doc_id, k, a, b - a, ids[a:b].astype("<u4").tobytes()) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
        columns = list(zip(*rows, strict=True))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids"])


def tokenize(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """One row per piece of each document: doc_id, piece, start, length, ids (little-endian unsigned 32-bit numbers)."""
    small_batches(docs.sparkSession)
    path = vocabulary or vocabulary_path()
    return only(docs, doc_id="long", text="string").mapInArrow(lambda b: _pieces(b, path, capacity), "doc_id long, piece int, start long, length long, ids binary")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best fit, longest first, over counts: runs (length, first rank, pieces, first sequence, offset).

    The pieces of a run stand at one offset of consecutive sequences. Sequences filled to the same height are kept as runs of
    numbers, so the work and the plan grow with the number of lengths, not of pieces. Best fit fills a sequence with a length as
    long as it has room before it turns to the next, so a run takes no more sequences than its pieces fill.
    """
    heights: dict[int, list[tuple[int, int]]] = {}  # free space -> runs (first sequence, how many)
    free: list[int] = []  # sorted
    runs, new = [], 0

    def give(space: int, first: int, n: int) -> None:
        if n and space:
            if space not in heights:
                heights[space] = []
                bisect.insort(free, space)
            heights[space].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            k = bisect.bisect_left(free, length)
            if k < len(free):
                space = free[k]
                first, n = heights[space].pop()
                if not heights[space]:
                    del heights[space]
                    free.pop(k)
                used = min(n, max(1, left // (space // length)))
                give(space, first + used, n - used)
            else:
                space, first, used = capacity, new, max(1, left // (capacity // length))
                new += used
            runs.append((length, rank, used, first, capacity - space))
            give(space - length, first, used)
            rank, left = rank + used, left - used
    return runs


def assign(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` from 1 to ``capacity``; other columns pass through.

    Counts per length go to the driver: ``capacity`` numbers at most. A rank within a length comes in two steps: a length's
    pieces are dealt by hash to about the square root of their number of parts, ranked within a part, and placed behind
    the parts before; so the commonest length is spread over many tasks. ``pieces`` is read twice and should be a stored
    table. Ranks order equal pieces by their own columns; between wholly equal rows either order gives the same rows.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return pieces.withColumn("sequence_id", F.lit(None).cast("long")).withColumn("offset", F.lit(None).cast("long"))
    parts = spark.createDataFrame([(k, max(1, int(n**0.5))) for k, n in counts.items()], "length long, parts int")
    slots = spark.createDataFrame(plan(counts, capacity), "length long, first_rank long, n long, first_sequence long, offset long")
    own = [c for c in pieces.columns if c != "length"]
    # Both tables are bounded by the number of lengths; see plan().
    dealt = pieces.join(F.broadcast(parts), "length").withColumn("_part", F.pmod(F.xxhash64(*own), "parts").cast("int"))
    ranked = dealt.withColumn("_in", F.row_number().over(Window.partitionBy("length", "_part").orderBy(*own)) - 1)
    sizes = dealt.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("length", "_part", "_before")
    placed = ranked.join(before, ["length", "_part"]).withColumn("_rank", F.col("_before") + F.col("_in"))
    runs = slots.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first_rank", "first_sequence", "offset", "n"))).alias("_runs"))
    found = placed.join(F.broadcast(runs), "length").withColumn("_run", F.filter("_runs", lambda r: (F.col("_rank") >= r["first_rank"]) & (F.col("_rank") < r["first_rank"] + r["n"]))[0])
    out = found.withColumn("sequence_id", F.col("_run.first_sequence") + F.col("_rank") - F.col("_run.first_rank")).withColumn("offset", F.col("_run.offset"))
    return out.select(*pieces.columns, "sequence_id", "offset")


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with their ids and their places: doc_id, piece, start, length, ids, sequence_id, offset.

    Null and empty texts are a piece of the end id alone. A null doc_id is kept. Rows that repeat a doc_id are packed one by
    one. Extra columns are ignored. No documents: no rows.
    """
    return assign(stored(tokenize(docs, capacity, vocabulary), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence: sequence_id, ids (bytes, pieces in place). A sequence has ``capacity`` pieces at most."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: F.hex(x["ids"]))
    return packed.groupBy("sequence_id").agg(F.unhex(F.array_join(parts, "")).alias("ids"))


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns. The checksum takes the ids' place before slots are assigned, so ids are not shuffled for it."""
    pieces = tokenize(docs).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return assign(stored(pieces, "pieces"))
