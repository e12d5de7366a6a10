"""Line dedup: lines that many documents share stay in one of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import SPACE, ascii_lower, only


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def repeated_lines(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """Key hashes (ka, kb) found in at least ``min_docs`` documents, with the largest doc_id that holds each."""
    key = F.col("key")
    lines = docs.select("doc_id", F.explode(F.array_distinct(F.transform(F.split("text", "\n", -1), line_key))).alias("key")).filter(F.char_length(key) >= min_chars)
    once = lines.select("doc_id", F.xxhash64(key).alias("ka"), F.xxhash64(F.lit(1), key).alias("kb")).distinct()
    return once.groupBy("ka", "kb").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("holder")).filter(F.col("n_docs") >= min_docs)


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, text (the kept lines), n_lines (before), n_dropped; ``row`` columns pass through.

    Lines are split at \\n. Keys of at least ``min_chars`` code points found in at least ``min_docs`` distinct doc_ids lose
    all their lines but those of the largest doc_id. Null and empty texts are one empty line. A null doc_id is a document
    of its own name, smaller than all others. Rows that repeat a doc_id count as one document, and each keeps its own row.
    All other columns of ``docs`` are kept as they are; those called text, n_lines or n_dropped are replaced.

    Plan: documents per key are counted in two steps (doc_id and key, then key), each with partial sums, so that a line of a
    third of all rows is a row per task. The repeated keys alone are joined back, by an equi-join that Spark may split where
    a key is hot. Texts are shuffled at most once, by row, and not at all where the list of drops is small.
    """
    base = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    keyed = base.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    repeated = repeated_lines(keyed, min_chars, min_docs)
    exploded = keyed.select("doc_id", F.explode(F.array_distinct(F.transform(F.split("text", "\n", -1), line_key))).alias("key")).filter(F.char_length("key") >= min_chars)
    mine = exploded.select("doc_id", F.xxhash64("key").alias("ka"), F.xxhash64(F.lit(1), "key").alias("kb"))
    # max() passes over the null id, so a line that the document without id alone holds has no holder, and stays there.
    elsewhere = F.col("holder").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") < F.col("holder")))
    drops = mine.join(repeated, ["ka", "kb"]).filter(elsewhere).groupBy(F.col("doc_id").alias("__line_doc")).agg(F.collect_set("ka").alias("__line_drop"))
    joined = base.join(drops, F.col("doc_id").cast("long").eqNullSafe(F.col("__line_doc")), "left")
    lines = F.split("text", "\n", -1)
    gone = lambda x: (F.char_length(line_key(x)) >= min_chars) & F.array_contains("__line_drop", F.xxhash64(line_key(x)))
    kept = F.when(F.col("__line_drop").isNull(), lines).otherwise(F.filter(lines, lambda x: ~gone(x)))
    done = joined.withColumn("__line_kept", kept).withColumn("n_lines", F.size(lines).cast("long"))
    done = done.withColumn("n_dropped", F.col("n_lines") - F.size("__line_kept").cast("long")).withColumn("text", F.array_join("__line_kept", "\n"))
    return done.drop("__line_kept", "__line_drop", "__line_doc")


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns: doc_id, n_lines, n_dropped, kept_sha256."""
    out = dedup_lines(only(docs, doc_id="long", text="string"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (SELECT doc_id, unnest(t) AS line, generate_subscripts(t, 1) AS pos
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS t FROM documents)),
     k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
     r AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
     m AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.holder AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
