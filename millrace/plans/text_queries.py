"""Queries over labels, spans, paths and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import arrays as A
from millrace.functions import text as T
from millrace.operators import manifests as M
from millrace.plans.series_queries import events, r6, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None):
    def add(job):
        QUERIES[job.__name__] = job
        if oracle:
            ORACLES[job.__name__] = oracle
        return job

    return add


NORM = "CASE WHEN regexp_matches({0}, 'bonafide|bona-fide|genuine|real') THEN 'real' WHEN regexp_matches({0}, 'spoof|fake|manip|partial|tampered') THEN 'fake' ELSE 'real' END"


@query(f"SELECT doc_id, {NORM.format('lower(trim(coalesce(text, chr(32))))')} AS label FROM documents")
def normalize_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_label(F.col("text")).alias("label"))


@query(f"SELECT doc_id, coalesce(source, CAST(doc_id AS VARCHAR)) AS path, {NORM.format('lower(trim(concat_ws(chr(32), lang, source, text)))')} AS label FROM documents")
def row_path_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.coalesce("source", F.col("doc_id").cast("string")).alias("path"), T.normalize_label(F.concat_ws(" ", "lang", "source", "text")).alias("label"))


def span_text() -> Column:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return F.concat(k % 7000, F.lit("-"), c % 9000, F.lit("-T/"), c % 50, F.lit(":"), k % 40, F.lit("-F"))


SPAN_SQL = "(o_orderkey % 7000) || '-' || (o_custkey % 9000) || '-T/' || (o_custkey % 50) || ':' || (o_orderkey % 40) || '-F'"
SPANS = f"""WITH o AS (SELECT o_orderkey, {SPAN_SQL} AS t FROM orders),
 x AS (SELECT o_orderkey, unnest(regexp_extract_all(t, '(\\d+(?:\\.\\d+)?)\\s*[-:]\\s*(\\d+(?:\\.\\d+)?)', 1)) AS a, unnest(regexp_extract_all(t, '(\\d+(?:\\.\\d+)?)\\s*[-:]\\s*(\\d+(?:\\.\\d+)?)', 2)) AS b FROM o),
 p AS (SELECT o_orderkey, least(a::DOUBLE, b::DOUBLE) AS s, greatest(a::DOUBLE, b::DOUBLE) AS e FROM x) """


@query(SPANS + "SELECT * FROM p")
def parse_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(T.spans(span_text())).alias("x")).select("o_orderkey", "x.s", "x.e")


@query("SELECT o_orderkey, least(a, b)::DOUBLE AS s, greatest(a, b)::DOUBLE AS e FROM (SELECT o_orderkey, o_custkey % 100 AS a, o_orderkey % 90 AS b FROM orders)")
def parse_number_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.array(F.lit("id"), (F.col("o_custkey") % 100).cast("string"), F.lit("x"), (F.col("o_orderkey") % 90).cast("string"), F.lit("7"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(T.number_pairs(tokens)).alias("x")).select("o_orderkey", "x.s", "x.e")


@query(SPANS + ", v AS (SELECT *, count(*) OVER w AS n, count(*) FILTER (WHERE (s > 2000 AND e > 2000) OR e - s > 5000) OVER w AS m FROM p WINDOW w AS (PARTITION BY o_orderkey)) SELECT o_orderkey, round(s / CASE WHEN m >= greatest(1, n // 2) THEN 1000 ELSE 1 END, 6)::DOUBLE AS s, round(e / CASE WHEN m >= greatest(1, n // 2) THEN 1000 ELSE 1 END, 6)::DOUBLE AS e FROM v")
def ms_to_sec_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(T.milliseconds_to_seconds(T.spans(span_text()))).alias("x")).select("o_orderkey", r6("x.s", "s"), r6("x.e", "e"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN o_custkey % 50 ELSE o_custkey % 30 END::DOUBLE AS s, CASE o_orderkey % 3 WHEN 0 THEN 2.5 WHEN 1 THEN o_custkey % 50 + 3 ELSE o_custkey % 30 + 4 END::DOUBLE AS e FROM orders")
def row_segments_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, kind = F.col("o_custkey"), F.col("o_orderkey") % 3
    field = F.when(kind == 0, F.lit("1.0-2.5")).otherwise(F.lit(""))
    start = F.when(kind == 1, F.array((c % 50).cast("string"), (c % 50 + 3).cast("string"))).otherwise(F.array().cast("array<string>"))
    text = F.when(kind == 2, F.concat(F.lit('[{"start": '), c % 30, F.lit(', "end": '), c % 30 + 4, F.lit("}]"))).otherwise(F.lit("[[9, 9.5]]"))
    found = T.first_segments(T.spans(field), T.number_pairs(start), T.json_segments(text))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(found).alias("x")).select("o_orderkey", "x.s", "x.e")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_items_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrapped = F.concat(F.lit('{"items": ['), "props", F.lit("]}"))
    parsed = F.from_json(wrapped, "items array<struct<k:bigint>>, data array<struct<k:bigint>>, entries array<struct<k:bigint>>")
    items = table(spark, sf_dir, "events").withColumn("_p", parsed)
    return items.select("event_id", F.explode(F.coalesce("_p.items", "_p.data", "_p.entries")).alias("x")).select("event_id", "x.k")


@query("SELECT page_id, CASE WHEN regexp_matches(lower(url), '/fake/|spoof') THEN 'fake' ELSE 'real' END AS label, CASE WHEN contains(lower(url), 'blog') THEN 'BLOG' WHEN contains(lower(url), 'www') THEN 'WEB' ELSE coalesce(nullif(regexp_extract(url, '/(?:raw|data|de|fr)/([^/]+)/', 1), ''), 'unknown') END AS dataset FROM pages")
def folder_label_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.folder_label(F.col("url")).alias("label"), T.detect_dataset(F.col("url"), [("blog", "BLOG"), ("www", "WEB")], "raw|data|de|fr").alias("dataset"))


@query("SELECT page_id, lower(regexp_extract(url, '(\\.[^./]+)$', 1)) AS ext, lower(regexp_extract(url, '(\\.[^./]+)$', 1)) IN ('.wav', '.flac', '.mp3', '.m4a', '.ogg') AS is_audio, lower(string_split(url, '/')[-1]) AS name, regexp_replace(lower(string_split(url, '/')[-1]), '\\.[^.]*$', '') AS stem, url || '.feat' AS sidecar FROM pages")
def path_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", T.extension(u).alias("ext"), T.has_audio_extension(u).alias("is_audio"), T.base_name(u).alias("name"), T.stem(u).alias("stem"), F.concat(u, F.lit(".feat")).alias("sidecar"))


@query("SELECT p_partkey, substr(sha1('{\"brand\": \"' || p_brand || '\", \"size\": ' || p_size || '}'), 1, 10) AS cfg FROM part")
def cfg_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('{"brand": "'), "p_brand", F.lit('", "size": '), "p_size", F.lit("}"))
    return table(spark, sf_dir, "part").select("p_partkey", T.config_hash(text).alias("cfg"))


@query("SELECT conv_id, turn, len(f)::BIGINT AS n_fields, f[1] AS token FROM (SELECT conv_id, turn, list_filter(list_transform(CASE WHEN contains(text, ',') THEN string_split(text, ',') ELSE regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+') END, lambda x: trim(x)), lambda x: x <> '') AS f FROM conversations) WHERE len(f) >= 2")
def text_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.split_fields(F.col("text")).alias("f"))
    return f.filter(F.size("f") >= 2).select("conv_id", "turn", F.size("f").cast("long").alias("n_fields"), F.get("f", 0).alias("token"))


@query("""WITH k AS (SELECT key, min(url) AS path FROM (SELECT url, unnest([lower(string_split(url, '/')[-1]), regexp_replace(lower(string_split(url, '/')[-1]), '\\.[^.]*$', '')]) AS key FROM pages) GROUP BY key),
 t AS (SELECT DISTINCT CAST(o_custkey * 3 % 30000 AS VARCHAR) || CASE WHEN o_custkey % 2 = 0 THEN '.HTML' ELSE '' END AS token FROM orders),
 c AS (SELECT token, unnest([1, 2]) AS p, unnest([lower(token), lower(token) || '.wav']) AS key FROM t)
 SELECT token, path FROM (SELECT token, path, row_number() OVER (PARTITION BY token ORDER BY p) AS o FROM c JOIN k USING (key)) WHERE o = 1""")
def resolve_path_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("o_custkey")
    tokens = table(spark, sf_dir, "orders").select(F.concat((c * 3 % 30000).cast("string"), F.when(c % 2 == 0, ".HTML").otherwise("")).alias("token")).distinct()
    return M.resolve(tokens, "token", M.path_index(table(spark, sf_dir, "pages"), "url"))


@query("SELECT doc_id, source FROM documents SEMI JOIN labels USING (doc_id)")
def has_features_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").select("doc_id", "source")


@query("SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)")
def missing_features_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "source")


@query("SELECT count(*) AS total, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels)) AS used, count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS missing FROM documents")
def coverage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.coverage(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT coalesce(a.tag, b.tag) AS tag, a.n AS n_docs, b.n AS n_orders FROM (SELECT lang AS tag, count(*) AS n FROM documents GROUP BY 1) a FULL JOIN (SELECT lower(substr(n_name, 1, 2)) AS tag, count(*) AS n FROM nation GROUP BY 1) b ON a.tag = b.tag")
def full_outer_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("tag")).agg(F.count(F.lit(1)).alias("n_docs"))
    b = table(spark, sf_dir, "nation").groupBy(F.lower(F.substring("n_name", 1, 2)).alias("tag")).agg(F.count(F.lit(1)).alias("n_orders"))
    return a.join(b, "tag", "full")


OVERLAP = "WITH v AS (SELECT event_id AS id, user_id, epoch_us(ts) / 1000000.0::DOUBLE AS s, epoch_us(ts) / 1000000.0::DOUBLE + 3600 AS e, event_type FROM events) "


def spans_of(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return events(spark, sf_dir).filter(F.col("event_type") == kind).select("user_id", F.col("event_id").alias("id"), F.col("t").alias("s"), (F.col("t") + 3600).alias("e"))


@query(OVERLAP + "SELECT a.id, b.id AS id2 FROM v a JOIN v b ON a.user_id = b.user_id AND a.s < b.e AND b.s < a.e WHERE a.event_type = 'view' AND b.event_type = 'click'")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.interval_overlaps(spans_of(spark, sf_dir, "view"), spans_of(spark, sf_dir, "click"), "user_id", 3600.0).select("id", "id2")


@query("SELECT doc_id, quality FROM labels UNION SELECT doc_id, toxic FROM labels UNION SELECT doc_id, quality FROM labels")
def manifest_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return M.union_distinct([labels, labels.select("doc_id", F.col("toxic").alias("quality")), labels], ["doc_id", "quality"])


@query("SELECT doc_id, source FROM documents WHERE source = (SELECT source FROM documents GROUP BY source ORDER BY count(*) DESC, min(doc_id) LIMIT 1)")
def majority_hash_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.keep_majority(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id")


VEC = "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS y FROM embeddings) "


@query(VEC + "SELECT vec_id, 14::INT AS dim, round(list_sum(y[1:5]) + list_sum(y[1:3]), 6) AS total, round(y[5], 6) AS fifth FROM e")
def vector_concat_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.col("y")
    v = A.concat_fixed([(F.slice(y, 1, 9), 5), (F.slice(y, 1, 3), 6), (F.lit(None).cast("array<double>"), 3)])
    e = table(spark, sf_dir, "embeddings").select("vec_id", A.doubles("embedding").alias("y"))
    return e.select("vec_id", F.size(v).alias("dim"), r6(A.total(v), "total"), r6(F.get(v, 4), "fifth"))


@query(VEC + "SELECT vec_id, round(y[1] + CASE WHEN vec_id % 3 = 0 THEN 0 WHEN vec_id % 3 = 1 THEN 1e6 ELSE -1e6 END, 6) AS total FROM e")
def vector_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.when(F.col("vec_id") % 3 == 0, F.lit(float("nan"))).when(F.col("vec_id") % 3 == 1, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    v = A.sanitize(F.array(F.get("embedding", 0).cast("double"), odd))
    return table(spark, sf_dir, "embeddings").select("vec_id", r6(A.total(v), "total"))


@query(VEC + "SELECT vec_id, len(y)::INT AS dim, round(list_min(y), 6) AS lo, round(list_max(y), 6) AS hi, round(list_avg(y), 6) AS mean_v, round(list_stddev_pop(y), 6) AS std_v, round(y[1], 6) AS head FROM e")
def vector_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.col("y")
    e = table(spark, sf_dir, "embeddings").select("vec_id", A.doubles("embedding").alias("y"))
    return e.select("vec_id", F.size(y).alias("dim"), r6(F.array_min(y), "lo"), r6(F.array_max(y), "hi"), r6(A.mean(y), "mean_v"), r6(A.std_pop(y), "std_v"), r6(F.get(y, 0), "head"))


@query(None)
def event_nms_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).filter("value IS NOT NULL").select("user_id", F.col("event_id").alias("id"), F.col("t").alias("s"), (F.col("t") + 7200).alias("e"), F.col("value").alias("score"))
    return M.nms(e, "user_id").select("user_id", F.size("kept").cast("long").alias("n_kept"), F.get("kept", 0)["id"].alias("best"))
