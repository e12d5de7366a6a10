"""Spelling variants: each word's whole neighbourhood is emitted and joined by hash with the vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import sketch
from millrace.llm.common import ascii_lower, discard, only, small_batches, stored
from millrace.llm.packed import GOLDEN, U64, mix, step

MIN_LENGTH, MIN_COUNT, DROP_EVERY, RATIO = 6, 5, 199, 5
#: Bits of the filter for each word, how many of them a word sets, and the most bits as a power of two: 64 MB.
WORD_BITS, PROBES, MOST_BITS = 32, 3, 29
#: Candidates that a task looks at together.
TOGETHER = 1 << 19
BASE = U64(0x9E3779B97F4A7C15)
BASE_INVERSE = U64(pow(int(BASE), -1, 1 << 64))
VALUE = mix((np.arange(256, dtype=U64) + U64(1)) * GOLDEN)


def words(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """Words (word, n) of ``docs`` (doc_id, text) with at least ``min_length`` code points and ``min_count`` occurrences.

    A run of letters loses a code point where 199 divides the crc32 of its row's id and itself; a null id is written as nothing.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{min_length},}}"), F.lit(0))).alias("_run"))
    runs = runs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), ascii_lower(F.col("_run")).alias("_run"))
    runs = runs.withColumn("_h", F.crc32(F.concat("_id", F.lit(":"), "_run")))
    at = F.pmod("_h", F.char_length("_run")).cast("int")
    shorter = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.char_length("_run")))
    word = F.when(F.pmod("_h", F.lit(DROP_EVERY)) == 0, shorter).otherwise(F.col("_run")).alias("word")
    return runs.select(word).filter(F.char_length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def _probe(hashed: np.ndarray, k: int, bits: int) -> np.ndarray:
    return (mix(hashed + step(k)) & U64((1 << bits) - 1)).astype(np.int64)


def _powers(n: int, factor: np.uint64) -> np.ndarray:
    out = np.full(n, factor, U64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _letters(strings: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of equal length: their places in ``strings`` and a matrix of their letters. All letters are below 256."""
    sizes = np.array([len(s) for s in strings], np.int64)
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        yield at, np.frombuffer("".join(strings[i] for i in at.tolist()).encode("latin-1"), np.uint8).reshape(-1, size)


def _bloom(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashed = [mix((VALUE[m] * _powers(m.shape[1], BASE)).sum(axis=1, dtype=U64) + step(m.shape[1])) for _, m in _letters(batch.column("word").to_pylist())]
        if hashed:
            yield sketch.part_batch(sketch.parts(np.concatenate([_probe(h, k, bits) for h in hashed for k in range(PROBES)]).astype(np.uint32), 0))


def neighbourhood(letters: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Every distinct string one deletion, replacement or insertion away from each word (a row of ``letters``), once, as
    (kind -1, 0 or 1; row; place; letter; hash of the result). A deletion's letter means nothing.

    In a run of equal letters only the first is deleted, and a letter is inserted only where it differs from the one it
    would stand before; so no result is made twice.
    """
    n, size = letters.shape
    power = _powers(size + 1, BASE)
    value = VALUE[letters] * power[:size]
    before = np.zeros((n, size + 1), U64)
    np.cumsum(value, axis=1, out=before[:, 1:])
    after = before[:, -1:] - before
    row, place = np.nonzero(np.concatenate([np.ones((n, 1), bool), letters[:, 1:] != letters[:, :-1]], axis=1))
    yield -1, row, place, np.zeros(len(row), np.uint8), mix(before[row, place] + after[row, place + 1] * BASE_INVERSE + step(size - 1))
    row, place, letter = np.nonzero(letters[:, :, None] != alphabet)
    yield 0, row, place, alphabet[letter], mix(before[row, place] + VALUE[alphabet[letter]] * power[place] + after[row, place + 1] + step(size))
    row, place, letter = np.nonzero(np.concatenate([letters[:, :, None] != alphabet, np.ones((n, 1, len(alphabet)), bool)], axis=1))
    yield 1, row, place, alphabet[letter], mix(before[row, place] + VALUE[alphabet[letter]] * power[place] + after[row, place] * BASE + step(size + 1))


def _candidates(batches: Iterator[pa.RecordBatch], shared: Broadcast, bits: int, alphabet: str) -> Iterator[pa.RecordBatch]:
    """The neighbourhood of each word, but for strings that the filter shows to be no words."""
    held, letters = sketch.bitmaps(shared), np.frombuffer(alphabet.encode("latin-1"), np.uint8)
    for batch in batches:
        strings = batch.column("word").to_pylist()
        for at, matrix in _letters(strings):
            step = max(1, TOGETHER // ((matrix.shape[1] + 1) * max(1, len(letters))))
            for i in range(0, len(at), step):
                sources, found = [], []
                for kind, row, place, letter, hashed in neighbourhood(matrix[i : i + step], letters):
                    left = np.arange(len(row))
                    for k in range(PROBES):
                        left = left[held.has(0, _probe(hashed[left], k, bits))]
                    for r, p, c in zip(row[left].tolist(), place[left].tolist(), letter[left].tolist(), strict=True):
                        word = strings[at[i + r]]
                        sources.append(word)
                        found.append(f"{word[:p]}{chr(c) if kind >= 0 else ''}{word[p + (kind < 1):]}")
                yield pa.RecordBatch.from_arrays([pa.array(sources, pa.string()), pa.array(found, pa.string())], ["word", "near"])


def near_words(vocabulary: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """All pairs (word, near, near_n) of words of ``vocabulary`` (word, n; a stored table) that differ by one inserted, deleted or replaced code point.

    Each word emits all distinct deletions, replacements and insertions over the letters that the vocabulary holds (code points
    below 256, so 256 at most). A Bloom filter of the vocabulary, WORD_BITS bits a word up to ``2 ** most_bits``, keeps most strings
    that are no words out of the shuffle; what passes meets the vocabulary in an equi-join on the string, which decides. So no pair is missed
    and none needs its distance measured. A string has no more sources than it has neighbours: no key of the join is hot.
    """
    spark = vocabulary.sparkSession
    facts = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c"))
    alphabet = "".join(sorted(r["c"] for r in facts.distinct().collect() if r["c"]))
    bits = min(most_bits, max(16, (vocabulary.count() * WORD_BITS).bit_length()))
    shared = sketch.merged(vocabulary.select("word").mapInArrow(lambda b: _bloom(b, bits), sketch.PART), 1, bits, 1)
    # Files of a small vocabulary are few; its neighbourhoods are many.
    dealt = vocabulary.select("word").repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "word")
    made = dealt.mapInArrow(lambda b: _candidates(b, shared, bits, alphabet), "word string, near string")
    return made.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word reached from each ``word`` of ``forms`` (word, form) by its form, that one's form, and so on.

    Steps double each round: a word's goal becomes its goal's goal, until none changes. A form is RATIO times as frequent
    as its word, so chains are short and have no rings.
    """
    reached = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = stored(reached.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        discard(reached)
        reached = moved
        if not moved.filter("_moved").limit(1).count():
            return reached.select("word", "root")


def spelling_variants(docs: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """Words of ``docs`` (doc_id, text) and the commoner word each is a variant of: word, form, root, n, n_near, form_n.

    Words are runs of letters (ASCII and U+00C0 to U+00FF; A-Z count as a-z) of at least 6 code points with at least 5 occurrences. A word's
    form is the most frequent of the words one edit away (of equal ones the first in code-point order), if that is 5 times
    as frequent; its root is the last of the chain of forms, itself where it has none.

    Null and empty texts have no words; a null doc_id counts as an empty string where code points are dropped. Repeated rows count as often
    as they stand. Very long texts are one row that is exploded into words. Extra columns are ignored. No words: no rows.
    """
    small_batches(docs.sparkSession)
    vocabulary = stored(words(only(docs, doc_id="long", text="string")), "vocabulary")
    # -n first, then the word: the least is the most frequent, of equal ones the first.
    best = near_words(vocabulary, most_bits).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("_best"))
    told = vocabulary.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("_best.m") >= RATIO * F.col("n"), F.struct(F.col("_best.near").alias("form"), (-F.col("_best.m")).alias("form_n"))).alias("_f"))
    told = stored(told.select("word", "_f.form", "n", "n_near", "_f.form_n"), "variants")
    discard(vocabulary)
    ends = roots(told.filter("form is not null"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
