"""Phrase collocations: merged count-min sketches find what may be frequent, a second pass counts just that, then phrases are scored."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import sketch
from millrace.llm.common import discard, only, small_batches, stored
from millrace.llm.packed import GOLDEN, U64, Numbers, arrow_bytes, hashes, mix, padded
from millrace.llm.wordhash import LOWERED, _chunks

LONGEST, MIN_COUNT, SCALE, COVERED_PERCENT, TOP = 4, 30, 2_000_000, 80, 2000
#: Rows of the sketch, and cells of a row as powers of two: a cell for every CELL_BYTES of text within these bounds.
DEPTH, LEAST_BITS, MOST_BITS, CELL_BYTES = 2, 16, 30, 8
#: Cells of a row that a task holds before it emits them.
FLUSH = 1 << 22
#: What parts words, and what parts pieces as well.
IS_BREAK = np.isin(np.arange(256), np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8))
IS_WORD = ~IS_BREAK & ~np.isin(np.arange(256), np.frombuffer(b" \t", np.uint8))
COUNTS = "lang string, k int, phrase string, n long"


class Part:
    """The words of some texts: their places, pieces and languages, and hashes of the phrases that begin at each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lang: np.ndarray, lang_hash: np.ndarray):
        data = LOWERED[data]
        inside = IS_WORD[data]
        # A text's first byte begins a word or piece whatever stands before it.
        firsts = offsets[:-1][offsets[:-1] < len(data)]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        begins[firsts] = inside[firsts]
        self.start = np.flatnonzero(begins)
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        ends[firsts[firsts > 0] - 1] = inside[firsts[firsts > 0] - 1]
        self.size = np.flatnonzero(ends) + 1 - self.start
        text = np.searchsorted(offsets, self.start, side="right") - 1
        breaks = np.flatnonzero(IS_BREAK[data])
        self.piece = np.searchsorted(breaks, self.start) + text
        self.lang, self.pad = lang[text], padded(data)
        own = mix(hashes(self.pad, self.start, self.size) ^ lang_hash[self.lang])
        self.phrases = [own]
        for k in range(2, LONGEST + 1):
            n = max(0, len(own) - k + 1)
            self.phrases.append(mix(self.phrases[-1][:n] * GOLDEN + own[k - 1 :]))

    def within(self, k: int) -> np.ndarray:
        """Whether the k words from each one on are of one piece."""
        n = len(self.phrases[k - 1])
        return self.piece[:n] == self.piece[k - 1 : k - 1 + n]

    def strings(self, first: np.ndarray, k: int) -> pa.Array:
        """The phrases of k words that begin at the words ``first``, joined by blanks."""
        if not len(first):
            return pa.array([], pa.string())
        words = first[:, None] + np.arange(k)
        start, size = self.start[words].ravel(), self.size[words].ravel() + 1
        upto = np.concatenate([[0], np.cumsum(size)])
        out = self.pad[np.repeat(start - upto[:-1], size) + np.arange(upto[-1])]
        out[upto[1:] - 1] = 32
        out = np.delete(out, upto[k::k] - 1)
        ends = upto[::k] - np.arange(len(first) + 1)
        return pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(out.tobytes())]).cast(pa.string())


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[Part, list[str]]]:
    data, offsets = arrow_bytes(batch.column("text"))
    named = batch.column("lang").dictionary_encode()
    names = named.dictionary.to_pylist()
    codes = np.array(named.indices)
    lang_hash = mix(np.array([zlib.crc32(x.encode()) for x in names], U64) * GOLDEN)
    for i, j in _chunks(offsets):
        yield Part(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], codes[i:j], lang_hash), names


def _cells(phrases: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (phrases >> U64(32 * row)) & U64((1 << bits) - 1)


def _sketch(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        phrases = np.concatenate(held)
        held.clear()
        return sketch.part_batch([p for row in range(DEPTH) for p in sketch.parts(_cells(phrases, row, bits).astype(np.uint32), row)])

    for batch in batches:
        for part, _ in _parts(batch):
            held += [part.phrases[k - 1][part.within(k)] for k in range(1, LONGEST + 1)]
            if sum(map(len, held)) >= FLUSH:
                yield flush()
    if held:
        yield flush()


_NUMBERS = Numbers(21)


def _count(batches: Iterator[pa.RecordBatch], shared: Broadcast, bits: int) -> Iterator[pa.RecordBatch]:
    """Exact counts, part by part, of the phrases that the sketch lets pass; phrases are told apart by their words' bytes."""
    passing = sketch.bitmaps(shared)
    for batch in batches:
        for part, names in _parts(batch):
            if _NUMBERS.full:
                _NUMBERS.clear()
            words = _NUMBERS.number(part.pad, part.start, part.size)
            languages, totals = np.unique(part.lang, return_counts=True)
            rows = [(languages, 0, pa.array([""] * len(languages), pa.string()), totals)]
            number = single = None
            for k in range(1, LONGEST + 1):
                keep = part.within(k)
                if k > 1:  # no part of a frequent phrase is rarer than the phrase
                    keep &= (number[: len(keep)] >= 0) & (number[1 : len(keep) + 1] >= 0)
                at = np.flatnonzero(keep)
                for row in range(DEPTH):
                    at = at[passing.has(row, _cells(part.phrases[k - 1][at], row, bits).astype(np.int64))]
                keys = (part.lang[at].astype(np.int64) << 32) | words[at] if k == 1 else (number[at] << 32) | single[at + k - 1]
                _, first, inverse, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
                number = np.full(len(keep) + 1, -1, np.int64)
                number[at] = inverse
                single = number if k == 1 else single
                rows.append((part.lang[at[first]], k, part.strings(at[first], k), counts))
            for lang, k, strings, counts in rows:
                columns = [pa.array(names, pa.string()).take(pa.array(lang)), pa.array(np.full(len(lang), k, np.int32)), strings, pa.array(counts, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "k", "phrase", "n"])


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, most_bits: int = MOST_BITS) -> DataFrame:
    """Exact counts (lang, k, phrase, n) of all phrases of 1 to 4 words found ``min_count`` times or more in a language (255 at
    most). A row with k = 0 per language has the number of all its words.

    The first pass gives every task's phrases to a count-min sketch of DEPTH rows; sums over all tasks overestimate, so no
    frequent phrase is lost. Rows have a cell for every CELL_BYTES of text, up to ``2 ** most_bits``; beyond that the sketch
    lets more rare phrases pass, which the second pass counts and drops: results do not change. One bit per cell is broadcast: 256 MB at most.
    """
    small_batches(docs.sparkSession)
    docs = only(docs, lang="string", text="string").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    bits = min(most_bits, max(LEAST_BITS, (size // CELL_BYTES).bit_length()))
    shared = sketch.merged(docs.mapInArrow(lambda b: _sketch(b, bits), sketch.PART), DEPTH, bits, min_count)
    counted = docs.mapInArrow(lambda b: _count(b, shared, bits), COUNTS).groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n"))
    out = stored(counted.filter((F.col("k") == 0) | (F.col("n") >= min_count)), "phrase-counts")
    shared.destroy()
    return out


def _words(phrase: Column, first: Column, k: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, k), " ")


def scored(counts: DataFrame) -> DataFrame:
    """Candidates of phrase_counts(): lang, k, phrase, a, l, r, score, and ``longer``, the most often that a longer candidate around it is found."""
    known = counts.filter("k > 0").select("lang", "phrase", F.col("n").alias("f"))
    cands = counts.filter("k > 1").select("lang", "k", "phrase", F.col("n").alias("a"))
    cuts = cands.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumn("_left", _words(F.col("phrase"), F.lit(1), F.col("cut"))).withColumn("_right", _words(F.col("phrase"), F.col("cut") + 1, F.col("k") - F.col("cut")))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("_left"), F.col("f").alias("l")), ["lang", "_left"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("_right"), F.col("f").alias("r")), ["lang", "_right"])
    wide = lambda c: f"cast({c} as decimal(20,0))"
    score = F.expr(f"(cast({SCALE} as decimal(10,0)) * {wide('a')}) div ({wide('l')} + {wide('r')})")
    best = cuts.groupBy("lang", "k", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("_b")).select("lang", "k", "phrase", "a", "_b.l", "_b.r", "_b.score")
    inner = cands.filter("k > 2").select("lang", F.col("a").alias("longer"), "phrase", "k", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("m"))
    inner = inner.select("lang", "longer", "m", "phrase", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("m") + 1)).alias("at"))
    around = inner.select("lang", "longer", _words(F.col("phrase"), F.col("at"), F.col("m")).alias("phrase")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return best.join(around, ["lang", "phrase"], "left")


def collocations(docs: DataFrame, top: int = TOP, min_count: int = MIN_COUNT, most_bits: int = MOST_BITS) -> DataFrame:
    """The ``top`` phrases of each language of ``docs`` (lang, text): lang, rank, phrase, a, l, r, n, score.

    A-Z count as a-z. Texts are split at . , ; : ! ? and line ends into pieces, and those at blanks and tabs into words. A candidate has 2
    to 4 words and is found ``min_count`` times; its score is that of its lowest cut, 2,000,000 times its count over the sum of its
    parts' counts, rounded down. Candidates inside a longer one that is at least 80 % as frequent are dropped.

    A null language is ``und``; null and empty texts have no words. Ties of the score go to the more frequent, then to the phrase
    that is first by its bytes; of equal cuts the first counts. Repeated rows count as often as they stand. Very long texts are
    worked on whole, one at a time. Extra columns are ignored. No words: no rows.

    Candidates are ranked in two steps, first among those of equal hash modulo 64, so no task sorts a whole language.
    """
    counts = phrase_counts(docs, min_count, most_bits)
    kept = scored(counts).filter(f"longer is null or cast(100 as decimal(10,0)) * longer < cast({COVERED_PERCENT} as decimal(10,0)) * a")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    first = kept.withColumn("_deal", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("_in", F.row_number().over(Window.partitionBy("lang", "_deal").orderBy(*order))).filter(F.col("_in") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    totals = counts.filter("k = 0").select("lang", "n")
    out = stored(ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "collocations")
    discard(counts)
    return out


ORACLE = rf"""
WITH w AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM (
       SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
     g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
           FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest(range(1, {LONGEST + 1})) AS k) WHERE len(w) >= k)),
     f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= {MIN_COUNT}),
     n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
     s AS (SELECT c.lang, c.k, c.phrase, c.a, cut, x.a AS l, y.a AS r, CAST((CAST({SCALE} AS HUGEINT) * c.a) // (CAST(x.a AS HUGEINT) + y.a) AS BIGINT) AS score
           FROM (SELECT *, string_split(phrase, ' ') AS p, unnest(range(1, k)) AS cut FROM f WHERE k > 1) c
           JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(p[1:cut], ' ')
           JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(p[cut + 1:], ' ')),
     b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
     i AS (SELECT lang, a, array_to_string(p[j:j + m - 1], ' ') AS phrase FROM (
           SELECT *, unnest(range(1, k - m + 2)) AS j FROM (SELECT lang, a, k, string_split(phrase, ' ') AS p, unnest(range(2, k)) AS m FROM f WHERE k > 2))),
     o AS (SELECT lang, phrase, max(a) AS longer FROM i GROUP BY ALL),
     t AS (SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, b.a DESC, phrase) AS rank FROM b LEFT JOIN o USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < {COVERED_PERCENT} * b.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM t JOIN n USING (lang) WHERE rank <= {TOP}
"""
