"""Queries of metrics and splits, and the relational suite over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import arrays as A
from millrace.operators import metrics as K
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


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels")


@query("SELECT round(avg((quality = toxic)::INT), 6) AS accuracy, count(*) AS n FROM labels")
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.accuracy(labels(spark, sf_dir), "quality", "toxic").select(r6("accuracy", "accuracy"), "n")


REPORT = """WITH c AS (SELECT l AS label, count(*) FILTER (WHERE quality = l AND toxic = l) AS tp, count(*) FILTER (WHERE quality = l) AS support, count(*) FILTER (WHERE toxic = l) AS pr FROM labels, (SELECT unnest([0, 1]) AS l) GROUP BY l),
 p AS (SELECT *, CASE WHEN pr = 0 THEN 0 ELSE tp / pr END AS precision, CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall FROM c),
 f AS (SELECT label::VARCHAR AS label, precision, recall, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1, support FROM p)
 SELECT label, round(precision, 6)::DOUBLE AS precision, round(recall, 6)::DOUBLE AS recall, round(f1, 6)::DOUBLE AS f1, support FROM (SELECT * FROM f UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM f
 UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)::BIGINT FROM f)"""


@query(REPORT)
def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = K.class_report(labels(spark, sf_dir), "quality", "toxic")
    return out.select("label", *[r6(c, c) for c in ("precision", "recall", "f1")], "support")


@query("SELECT t AS truth, p AS pred, count(l.doc_id) AS n FROM (SELECT unnest([0, 1])::INT AS t), (SELECT unnest([0, 1])::INT AS p) LEFT JOIN labels l ON quality = t AND toxic = p GROUP BY ALL")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.confusion(labels(spark, sf_dir), "quality", "toxic")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source"), "doc_id")


SCORED = "WITH s AS (SELECT doc_id, quality, toxic, n_chars, source FROM labels JOIN documents USING (doc_id)) "


@query(SCORED + ", g AS (SELECT n_chars, sum(quality) AS pos, sum(1 - quality) AS neg FROM s GROUP BY 1), c AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY n_chars ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g) SELECT round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6)::DOUBLE AS auc FROM c")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.roc_auc(scored(spark, sf_dir), "quality", "n_chars").select(r6("auc", "auc"))


@query(SCORED + ", g AS (SELECT n_chars, sum(quality) AS pos, sum(1 - quality) AS neg FROM s GROUP BY 1) SELECT n_chars AS threshold, round(sum(neg) OVER o / sum(neg) OVER (), 6)::DOUBLE AS fpr, round(sum(pos) OVER o / sum(pos) OVER (), 6)::DOUBLE AS tpr FROM g WINDOW o AS (ORDER BY n_chars DESC)")
def roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.roc_points(scored(spark, sf_dir), "quality", "n_chars").select("threshold", r6("fpr", "fpr"), r6("tpr", "tpr"))


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", A.doubles("embedding").alias("y"))


@query("SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS score FROM embeddings ORDER BY embedding[1] DESC, vec_id LIMIT 20")
def top_k_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.top_k(heads(spark, sf_dir).select("vec_id", F.get("y", 0).alias("score")), "score", "vec_id", 20).select("vec_id", r6("score", "score"))


@query("SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS score FROM embeddings ORDER BY embedding[1], vec_id LIMIT 20")
def top_k_neg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.top_k(heads(spark, sf_dir).select("vec_id", F.get("y", 0).alias("score")), "score", "vec_id", 20, ascending=True).select("vec_id", r6("score", "score"))


@query("SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INT AS class FROM embeddings")
def first_argmax_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heads(spark, sf_dir).select("vec_id", A.first_argmax(F.col("y")).alias("class"))


@query("WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS i FROM embeddings), e AS (SELECT *, exp(v - max(v) OVER (PARTITION BY vec_id)) AS e FROM x) SELECT vec_id, i, round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS p FROM e")
def softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heads(spark, sf_dir).select("vec_id", F.posexplode(A.softmax(F.col("y"))).alias("i", "p")).select("vec_id", F.col("i").cast("long").alias("i"), r6("p", "p"))


@query(SCORED + "SELECT doc_id, CASE WHEN n_chars >= 1000 THEN 'fake' ELSE 'real' END AS pred FROM s")
def threshold_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("doc_id", F.when(F.col("n_chars") >= 1000, "fake").otherwise("real").alias("pred"))


@query(SCORED + "SELECT source, round(avg((quality = toxic)::INT), 6) AS acc, count(*) AS n FROM s GROUP BY source")
def group_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).groupBy("source").agg(r6(F.avg((F.col("quality") == F.col("toxic")).cast("double")), "acc"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("acc"), "source")


@query(SCORED + "SELECT source AS model, round(avg((quality = toxic)::INT), 6) AS acc FROM s GROUP BY source ORDER BY 2 DESC, 1 LIMIT 1")
def best_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = scored(spark, sf_dir).groupBy("source").agg(r6(F.avg((F.col("quality") == F.col("toxic")).cast("double")), "acc"))
    return g.orderBy(F.desc("acc"), "source").limit(1).select(F.col("source").alias("model"), "acc")


@query("SELECT label, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6)::DOUBLE AS weight FROM embeddings GROUP BY label")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.class_weights(table(spark, sf_dir, "embeddings"), "label").select("label", "n", r6("weight", "weight"))


@query("SELECT source AS label, (row_number() OVER (ORDER BY source) - 1)::INT AS code FROM (SELECT DISTINCT source FROM documents)")
def label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.encode_labels(table(spark, sf_dir, "documents").select(F.col("source").alias("label")), "label")


@query("SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(vec_id::VARCHAR || '1337'), vec_id) * 100 <= count(*) OVER (PARTITION BY label) * 20 AS is_test FROM embeddings")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.stratified_split(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", "vec_id", 20, "1337")


# The relational suite.


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def rel_pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), r6(F.avg("l_discount"), "avg_disc"), F.count(F.lit(1)).alias("n"))


@query("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name")
def rel_star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus)::INT AS g1, grouping(o_orderpriority)::INT AS g2 FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def rel_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.grouping("o_orderstatus").cast("int").alias("g1"), F.grouping("o_orderpriority").cast("int").alias("g2"))


@query("SELECT p_brand, p_type, round(avg(p_retailprice), 6) AS price FROM part GROUP BY ROLLUP (p_brand, p_type)")
def rel_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").rollup("p_brand", "p_type").agg(r6(F.avg("p_retailprice"), "price"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def rel_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def rel_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).exceptAll(table(spark, sf_dir, "orders").select("o_custkey").distinct()).distinct()


@query("SELECT c_nationkey, c_custkey, r, d FROM (SELECT c_nationkey, c_custkey, rank() OVER w AS r, dense_rank() OVER w AS d FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)) WHERE r <= 3")
def rel_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("d")).filter("r <= 3")


@query("SELECT event_type, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS w, count(*) AS n, round(avg(value), 6) AS v FROM events GROUP BY ALL")
def rel_tumbling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("event_type", F.window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value"), "v")).select("event_type", F.col("w.start").alias("w"), "n", "v")


@query("SELECT event_type, w, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') - INTERVAL '6 hours']) AS w FROM events) GROUP BY ALL")
def rel_sliding_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("event_type", F.window("ts", "12 hours", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("event_type", F.col("w.start").alias("w"), "n")
