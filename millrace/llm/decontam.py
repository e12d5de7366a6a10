"""Benchmark decontamination: one automaton over the windows of all items scans each text once."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import LOWER, UPPER, discard, only, small_batches, stored

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWERED = str.maketrans(UPPER, LOWER)
#: Bytes of item texts that one automaton is built over; more items are scanned for in several blocks.
BLOCK_BYTES = 8 << 20

HITS = "hits array<struct<first:int,last:int,start:int,end:int,window:long>>, windows array<struct<window:long,item_ids:array<long>>>"
SCHEMA = f"doc_id long, n_words long, {HITS}"


def item_windows(text: str | None, size: int) -> list[str]:
    """Windows of an item as blank-separated words: each run of ``size`` words; for fewer, but not none, all of them."""
    words = WORD.findall((text or "").translate(LOWERED))
    return [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


def automaton(items: list[tuple[int, str | None]], size: int):
    """Aho-Corasick automaton over the windows, each with blanks around it; a window's value is its words, its number and its items."""
    import ahocorasick

    owners: dict[str, set] = {}
    for item_id, text in items:
        for window in item_windows(text, size):
            owners.setdefault(window, set()).add(item_id)
    found = ahocorasick.Automaton()
    for number, (window, ids) in enumerate(owners.items()):
        found.add_word(f" {window} ", (window.count(" ") + 1, number, sorted(ids, key=lambda x: (x is not None, x))))
    if owners:
        found.make_automaton()
    return found if owners else None


def scan_windows(text: str, found) -> tuple[int, list[dict], dict[int, list]]:
    """Number of words; a row per occurrence of a window: its first and last word, its span in the text and the window's number;
    and the items of each window that occurs, once: so many items with one window do not multiply its occurrences."""
    lowered = text.translate(LOWERED)  # places stay the same
    words = WORD.findall(lowered)
    if found is None or not words:
        return len(words), [], {}
    line = f" {' '.join(words)} "
    hits, seen, upto, spans, owners = [], 0, 0, None, {}
    for at, (size, number, ids) in found.iter(line):
        # `at` is the blank after the window's last word; blanks up to it, the first one aside, number the words.
        seen += line.count(" ", upto, at)
        upto = at
        if spans is None:
            spans = [m.span() for m in WORD.finditer(lowered)]
        last = seen - 1
        first = last - size + 1
        hits.append({"first": first, "last": last, "start": spans[first][0], "end": spans[last][1], "window": number})
        owners[number] = ids
    return len(words), hits, owners


def scan_text(text: str, found) -> tuple[int, list[dict]]:
    """Number of words, and a row per occurrence of a window and item: for single texts, where items that share windows are few."""
    n, hits, owners = scan_windows(text, found)
    return n, [{k: v for k, v in h.items() if k != "window"} | {"item_id": i} for h in hits for i in owners[h["window"]]]


_BUILT: dict[tuple, object] = {}


def _automaton(shared: Broadcast, size: int):
    """The automaton of a broadcast block, built once per worker."""
    key, items = shared.value
    if (key, size) not in _BUILT:
        _BUILT.clear()
        _BUILT[key, size] = automaton(items, size)
    return _BUILT[key, size]


def _scan(batches: Iterator[pa.RecordBatch], shared: Broadcast, size: int, block: int = 0) -> Iterator[pa.RecordBatch]:
    found = _automaton(shared, size)
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("window", pa.int64())]))
    held = pa.list_(pa.struct([("window", pa.int64()), ("item_ids", pa.list_(pa.int64()))]))
    for batch in batches:
        got = [scan_windows(text or "", found) for text in batch.column("text").to_pylist()]
        for _, hits, _ in got:
            for h in hits:
                h["window"] += block << 32
        owners = [[{"window": k + (block << 32), "item_ids": ids} for k, ids in own.items()] for _, _, own in got]
        keys = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, keys), pa.array([n for n, _, _ in got], pa.int64()), pa.array([h for _, h, _ in got], kind), pa.array(owners, held)], [*keys, "n_words", "hits", "windows"])


def find_windows(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, the occurrences of item windows (``hits``) and the items of each window (``windows``).

    Item texts are measured first. Up to BLOCK_BYTES they are one broadcast block and one automaton; more are cut by hash
    into blocks of about that size, and the documents are scanned once for each. So a broadcast never exceeds the block.
    With several blocks each row has a stored number, by which its scans meet again: rows that repeat a doc_id, or have none,
    stay apart. A block's hits are stored, and the block is released, before the next one is read.
    """
    small_batches(docs.sparkSession)
    docs = only(docs, doc_id="long", text="string")
    n = _n_blocks(items)
    if n == 1:
        shared = next(_blocks(items, n))
        return docs.mapInArrow(lambda b: _scan(b, shared, size), SCHEMA)
    docs = stored(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    found: list[DataFrame] = []
    for k, shared in enumerate(_blocks(items, n)):
        scanned = docs.mapInArrow(lambda b, shared=shared, k=k: _scan(b, shared, size, k), f"doc_id long, _row long, {SCHEMA.split(', ', 1)[1]}")
        found.append(stored(scanned.filter(F.size("hits") > 0) if found else scanned, "hits"))  # the first scan has every row
        shared.destroy()
    whole = reduce(DataFrame.unionByName, found)
    return whole.groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("windows")).alias("windows")).drop("_row")


def _n_blocks(items: DataFrame) -> int:
    """How many blocks of about BLOCK_BYTES the items make; one for no items."""
    return 1 + items.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0)).alias("b")).first()["b"] // BLOCK_BYTES


def _blocks(items: DataFrame, n: int) -> Iterator[Broadcast]:
    """The items in ``n`` broadcast blocks by hash, one after the other: the driver holds the rows of one block at a time."""
    spark = items.sparkSession
    items = only(items, item_id="long", text="string")
    for k in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield spark.sparkContext.broadcast((uuid.uuid4().hex, [(r["item_id"], r["text"]) for r in part.collect()]))


def _clean(batches: Iterator[pa.RecordBatch], shared: Broadcast, size: int) -> Iterator[pa.RecordBatch]:
    found = _automaton(shared, size)
    for batch in batches:
        yield batch.filter(pa.array([not scan_windows(text or "", found)[1] for text in batch.column("text").to_pylist()], pa.bool_()))


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """Rows of ``docs`` without any item's window, with all their columns; one pass for each block of items, no shuffle.

    Between two blocks the rows that are left are stored and the block is released, so a task never holds more than one automaton.
    """
    small_batches(docs.sparkSession)
    n = _n_blocks(items)
    before: DataFrame | None = None
    for k, shared in enumerate(_blocks(items, n)):
        docs = docs.mapInArrow(lambda b, shared=shared: _clean(b, shared, size), docs.schema)
        if k < n - 1:
            docs = stored(docs, "clean")
            shared.destroy()
            if before is not None:
                discard(before)
            before = docs
    return docs


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_hit, n_items, names = [], [], []
        for hits, windows in zip(batch.column("hits").to_pylist(), batch.column("windows").to_pylist(), strict=True):
            upto, n = -1, 0
            for first, last in sorted((h["first"], h["last"]) for h in hits):
                n += max(0, last - max(first - 1, upto))
                upto = max(upto, last)
            ids = sorted({str(i) for w in windows for i in w["item_ids"] if i is not None})
            n_hit.append(n)
            n_items.append(len(ids))
            names.append(hashlib.sha256(",".join(ids).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_words"), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(names, pa.string()), pa.array([x > 0 for x in n_hit])],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit (words inside any occurrence), n_items, items_sha256, contaminated.

    Null and empty texts have no words and are clean. An item without words has no window. Items that share a window are all
    counted; one without an id hits words but has no name to count. Very long texts are scanned whole. Repeated rows are scanned as they stand, however many blocks the items make.
    Extra columns of either input are ignored.
    """
    return find_windows(docs, items, size).mapInArrow(_digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
     v AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win
           FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
     g AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
           FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM v) WHERE len(w) >= k)),
     h AS (SELECT g.doc_id, g.i, g.k, v.item_id FROM g JOIN v ON g.k = v.k AND g.win = v.win),
     n AS (SELECT doc_id, count(DISTINCT i + o) AS n_hit FROM (SELECT doc_id, i, unnest(range(0, k)) AS o FROM h) GROUP BY doc_id),
     s AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)
"""
