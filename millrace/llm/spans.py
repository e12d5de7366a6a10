"""Substring dedup: sentences inside any run of consecutive sentences that several documents hold go, but for the run's first place."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import only, small_batches, stored
from millrace.llm.packed import GOLDEN, MIX1, Numbers, arrow_bytes, hashes, mix, padded
from millrace.llm.wordhash import LOWERED, _chunks

#: A sentence ends behind . ! ? or a line feed and takes the white space that follows; a token takes the white space around it.
SENTENCE = r"[^.!?\n]*[.!?\n]+[ \t\r\n]*|[^.!?\n]+"
TOKEN, BARE = r"[ \t\r\n]*[^ \t\r\n]+[ \t\r\n]*", r"[^ \t\r\n]+"
#: Sentences of more than LONG tokens are cut behind the greatest of any WINDOW consecutive ones; a run has at least MIN_TOKENS.
LONG, WINDOW, MIN_TOKENS = 20, 16, 25
FIND = re.compile(SENTENCE.encode())
IS_BARE = ~np.isin(np.arange(256), np.frombuffer(b" \t\r\n", np.uint8))
RUNS = "id long, th long, at int, k int, ha long, hb long"
LEFT = "text string, n_sentences long, removed array<int>"


class Units(NamedTuple):
    """The units of texts laid end to end."""

    start: np.ndarray  # first byte
    n: np.ndarray  # tokens, at least 1
    first: np.ndarray  # number of its first token
    tokens: np.ndarray  # tokens in truth: 0 or n
    bounds: np.ndarray  # units of text i: bounds[i] to bounds[i + 1]
    token_start: np.ndarray
    token_size: np.ndarray
    pad: np.ndarray  # the bytes, A-Z lower-cased


def units(data: np.ndarray, offsets: np.ndarray) -> Units:
    """Sentences, and pieces of those with more than LONG tokens.

    These are cut behind each token that is the greatest, by its bytes and then its place, of some WINDOW consecutive tokens. Cuts
    depend on the tokens nearby alone, so text copied into the middle of a sentence is cut as it was where it came from; and
    no piece has more than WINDOW tokens.
    """
    raw = data.tobytes()
    starts = [m.start() + a for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) for m in FIND.finditer(raw[a:z])]
    sentence = np.array(starts, np.int64)
    lowered = LOWERED[data]
    bare = IS_BARE[data]
    begins, ends = bare.copy(), bare.copy()
    begins[1:] &= ~bare[:-1]
    ends[:-1] &= ~bare[1:]
    begins[sentence] = bare[sentence]  # a sentence, and so a text, begins a token whatever stands before
    ends[sentence[sentence > 0] - 1] = bare[sentence[sentence > 0] - 1]
    start = np.flatnonzero(begins)
    size = np.flatnonzero(ends) + 1 - start
    pad = padded(lowered)
    upto = np.append(np.searchsorted(start, sentence), len(start))  # tokens before each sentence
    count = np.diff(upto)
    cut = np.zeros(len(start) + 1, bool)  # whether a unit ends before the token
    if (long := np.flatnonzero(count > LONG)).size:
        held = np.repeat(upto[long] - np.concatenate([[0], np.cumsum(count[long])[:-1]]), count[long]) + np.arange(count[long].sum())
        strings: list[bytes] = []
        number = Numbers(16).number(pad, start[held], size[held], strings.extend)
        rank = np.empty(len(strings), np.int64)
        rank[sorted(range(len(strings)), key=strings.__getitem__)] = np.arange(len(strings))
        best = (rank[number] << 32) | np.arange(len(held))
        for k in (1, 2, 4, 8):  # the greatest of 2, 4, 8 and 16 from each on
            best = np.maximum(best[: len(best) - k], best[k:])
        owner = np.repeat(np.arange(len(long)), count[long])
        whole = owner[: len(best)] == owner[WINDOW - 1 :]
        cut[held[(best & 0xFFFFFFFF)[whole]] + 1] = True
    # A unit begins where a sentence does, or behind a cut within one; there, with its first token (white space before belongs to the token before).
    inner = np.flatnonzero(cut[:-1])
    inner = inner[~np.isin(inner, upto)]
    at = np.concatenate([sentence, start[inner]])
    first = np.concatenate([upto[:-1], inner])
    order = np.argsort(at, kind="stable")
    at, first = at[order], first[order]
    tokens = np.diff(np.append(first, len(start)))
    return Units(at, np.maximum(tokens, 1), first, tokens, np.searchsorted(at, offsets), start, size, pad)


def _fold(values: np.ndarray, first: np.ndarray, n: np.ndarray, seed: np.uint64) -> np.ndarray:
    """A hash of each list ``values[first:first + n]``."""
    out = mix(n.astype(np.uint64) * GOLDEN + seed)
    left, k = np.flatnonzero(n > 0), 0
    while left.size:
        out[left] = mix(out[left] * GOLDEN + values[first[left] + k])
        k += 1
        left = left[n[left] > k]
    return out


def _runs(batches: Iterator[pa.RecordBatch], min_tokens: int) -> Iterator[pa.RecordBatch]:
    """From each unit on the fewest consecutive units of its text that hold ``min_tokens`` tokens."""
    for batch in batches:
        data, offsets = arrow_bytes(batch.column("text"))
        for i, j in _chunks(offsets):
            u = units(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            upto = np.concatenate([[0], np.cumsum(u.n)])
            text = np.repeat(np.arange(j - i), np.diff(u.bounds))
            end = np.searchsorted(upto, upto[:-1] + min_tokens)
            own = np.flatnonzero(end <= u.bounds[text + 1])
            word = hashes(u.pad, u.token_start, u.token_size)
            columns = [batch.column(c).slice(i, j - i).take(pa.array(text[own])) for c in ("id", "th")]
            columns += [pa.array((own - u.bounds[text[own]]).astype(np.int32)), pa.array((end - np.arange(len(end)))[own].astype(np.int32))]
            for seed in (GOLDEN, MIX1):
                unit = _fold(word, u.first, u.tokens, seed)
                columns.append(pa.array(_fold(unit, own, (end - np.arange(len(end)))[own], seed).view(np.int64)))
            yield pa.RecordBatch.from_arrays(columns, ["id", "th", "at", "k", "ha", "hb"])


def _without(texts: pd.Series, places: pd.Series) -> pd.DataFrame:
    """Texts without the units that any of their places covers."""
    out = []
    for text, held in zip(texts, places, strict=True):
        raw = text.encode()
        n, gone = sum(1 for _ in FIND.finditer(raw)), []
        if held is not None and len(held):
            gone = sorted({i for r in held for i in range(r["at"], r["at"] + r["k"])})
            bounds = np.append(units(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).start, len(raw)).tolist()
            left = np.ones(len(bounds) - 1, bool)
            left[gone] = False
            text = b"".join(raw[bounds[i] : bounds[i + 1]] for i in np.flatnonzero(left).tolist()).decode()
        out.append((text, n, gone))
    return pd.DataFrame(out, columns=["text", "n_sentences", "removed"])


def dedup_spans(docs: DataFrame, min_tokens: int = MIN_TOKENS, min_docs: int = 2) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, text (what stays), n_sentences, n_removed (units), removed (their numbers from 0).

    Units are sentences; those of more than LONG tokens are cut into pieces at places that depend on the text nearby alone. From
    each unit on, the fewest consecutive units that hold ``min_tokens`` tokens are a run (several: no unit holds as many). Runs
    found in at least ``min_docs`` documents (1: repeats within one document too) keep their first place, the least (doc_id, hash of
    the text, unit number); units that any other place covers are removed, all else stays as it was. Token ends are blanks, tabs and
    line ends; A-Z count as a-z. A passage of over 50 words is met wherever it stands, even inside other sentences: its two
    ends lose some 20 words at most to units that it shares with the text around.

    Null and empty texts have no units. Texts with fewer tokens than a run are kept. A null doc_id comes before all others. Rows with
    equal doc_id and text are one document in several copies: their runs stand at the same places, so all stay. Rows that repeat a
    doc_id with another text are documents of their own. Ties of hashes have 128 bits. Very long texts are worked on whole, one at a time,
    and give a row per run. Extra columns pass through; those called text, n_sentences, n_removed or removed are replaced.

    Plan: runs are made once and stored. First places come from partial minima; those of repeated runs are stored too, so the join
    that finds the others may broadcast them by their size, or be split where a run is hot. Places join texts by (doc_id, hash of the text).
    """
    small_batches(docs.sparkSession)
    base = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    keyed = base.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("th"), "text")
    runs = stored(keyed.mapInArrow(lambda b: _runs(b, min_tokens), RUNS), "runs")
    doc, place = F.struct("id", "th"), F.struct("id", "th", "at")
    held = [F.min(place).alias("first"), F.min(doc).alias("least"), F.max(doc).alias("most"), F.max(place).alias("last")] + ([F.count_distinct(doc).alias("n")] if min_docs > 2 else [])
    repeated = "not (first <=> last)" if min_docs < 2 else "not (least <=> most)" if min_docs == 2 else f"n >= {int(min_docs)}"
    firsts = stored(runs.groupBy("ha", "hb").agg(*held).filter(repeated).select("ha", "hb", "first"), "first-runs")
    later = runs.join(firsts, ["ha", "hb"]).filter(~place.eqNullSafe(F.col("first")))
    covered = later.groupBy(F.col("id").alias("__span_id"), F.col("th").alias("__span_th")).agg(F.collect_set(F.struct("at", "k")).alias("__span_at"))
    joined = base.join(covered, F.col("doc_id").cast("long").eqNullSafe(F.col("__span_id")) & (F.xxhash64("text") == F.col("__span_th")), "left")
    done = joined.withColumn("__span_out", F.pandas_udf(_without, LEFT)("text", "__span_at"))
    done = done.withColumn("text", F.col("__span_out.text")).withColumn("n_sentences", F.col("__span_out.n_sentences")).withColumn("removed", F.col("__span_out.removed"))
    return done.withColumn("n_removed", F.size("removed").cast("long")).drop("__span_id", "__span_th", "__span_at", "__span_out")


def digest(docs: DataFrame) -> DataFrame:
    out = dedup_spans(only(docs, doc_id="long", text="string"))
    return out.select("doc_id", "n_sentences", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


ORACLE = rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SENTENCE}') AS s FROM documents),
     e AS (SELECT doc_id, generate_subscripts(s, 1) AS pos, unnest(s) AS sent FROM t),
     b AS (SELECT *, regexp_extract_all(sent, '{TOKEN}') AS toks, regexp_extract_all(translate(sent, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{BARE}') AS low FROM e),
     k AS (SELECT doc_id, pos, i, low[i] || chr(0) || lpad(CAST(i AS VARCHAR), 9, '0') AS x, len(low) AS n FROM (SELECT *, unnest(range(1, len(low) + 1)) AS i FROM b WHERE len(low) > {LONG})),
     c AS (SELECT DISTINCT doc_id, pos, CAST(right(m, 9) AS BIGINT) AS z FROM (SELECT doc_id, pos, i, n, max(x) OVER (PARTITION BY doc_id, pos ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS m FROM k) WHERE i <= n - {WINDOW - 1}),
     z AS (SELECT doc_id, pos, z FROM c UNION SELECT doc_id, pos, len(low) FROM b WHERE len(low) > {LONG}),
     p AS (SELECT doc_id, pos, z, z - coalesce(lag(z) OVER (PARTITION BY doc_id, pos ORDER BY z), 0) AS n FROM z),
     u AS (SELECT doc_id, pos, z, n, array_to_string(toks[z - n + 1:z], '') AS s, array_to_string(low[z - n + 1:z], ' ') AS key FROM p JOIN b USING (doc_id, pos)
           UNION ALL SELECT doc_id, pos, 0, greatest(len(low), 1), sent, array_to_string(low, ' ') FROM b WHERE len(low) <= {LONG}),
     o AS (SELECT *, row_number() OVER w - 1 AS nr, sum(n) OVER w - n AS upto, sum(n) OVER (PARTITION BY doc_id) AS total FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY pos, z ROWS UNBOUNDED PRECEDING)),
     r AS (SELECT doc_id, nr, upto, total, string_agg(key, chr(0)) OVER w AS run, count(*) OVER w AS k FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN CURRENT ROW AND {MIN_TOKENS - 1} FOLLOWING)),
     d AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, nr) AS place, min(doc_id) OVER (PARTITION BY run) <> max(doc_id) OVER (PARTITION BY run) AS several FROM r WHERE total - upto >= {MIN_TOKENS}),
     g AS (SELECT DISTINCT doc_id, nr FROM (SELECT doc_id, unnest(range(nr, nr + k)) AS nr FROM d WHERE place > 1 AND several))
SELECT t.doc_id, CAST(len(s) AS BIGINT) AS n_sentences, coalesce(c, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN (SELECT doc_id, count(*) AS c FROM g GROUP BY doc_id) USING (doc_id)
LEFT JOIN (SELECT doc_id, string_agg(s, '' ORDER BY nr) AS kept FROM o ANTI JOIN g USING (doc_id, nr) GROUP BY doc_id) USING (doc_id)
"""
