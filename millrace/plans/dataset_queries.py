"""Queries over protocol files read back and manifests of many datasets at once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import datasets
from millrace.plans.series_queries import table
from millrace.sources import protocols

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str):
    """Registers a function under its name, with its oracle."""

    def add(job):
        QUERIES[job.__name__] = job
        ORACLES[job.__name__] = oracle
        return job

    return add


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS token, CASE WHEN o_custkey % 3 = 0 THEN 'fake' ELSE 'real' END AS label, (o_custkey % 50)::DOUBLE AS s, (o_custkey % 50 + o_orderkey % 7)::DOUBLE AS e FROM orders""")
def protocol_files_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as protocol entries: half of them written as tables, half as lines, and read back together."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='millrace-protocols-')}"
    folder = f"{shared.rstrip('/')}/protocols/{uuid.uuid4().hex}"
    key, c = F.col("o_orderkey"), F.col("o_custkey") % 50
    rows = table(spark, sf_dir, "orders").select(key, F.when(F.col("o_custkey") % 3 == 0, "spoof").otherwise("bonafide").alias("class"), c.alias("onset"), (c + key % 7).alias("offset"))
    rows.filter(key % 2 == 0).select(key.alias("utt"), "class", "onset", "offset").write.csv(f"{folder}/tables", header=True)
    rows.filter(key % 2 != 0).select(F.concat_ws(" ", key, "class", F.concat("onset", F.lit("-"), "offset"))).write.text(f"{folder}/lines")
    return protocols.entries(spark, folder).select("token", "label", F.explode("segs").alias("x")).select("token", "label", "x.s", "x.e")


#: Datasets by nation: a third of each kind. Of datasets of kind had those of even numbers have no table; two of kind partial name no file.
DATASETS = """WITH f AS (SELECT c_nationkey AS n, CASE WHEN c_custkey % 4 = 0 THEN 'dev' ELSE 'train' END AS split, CAST(c_custkey AS VARCHAR) AS key FROM customer),
 a AS (SELECT n, split, key, '/d' || n || '/' || split || '/' || key || '.wav' AS path FROM f),
 o AS (SELECT o_orderkey % 25 AS n, substr(o_orderpriority, 1, 1) = '1' AND o_orderkey % 25 % 2 = 1 AS is_table, CAST(o_custkey AS VARCHAR) || CASE WHEN o_orderkey % 25 IN (4, 7) THEN 'x' ELSE '' END AS token, CASE WHEN o_custkey % 2 = 0 THEN 'fake' ELSE 'real' END AS label, o_orderkey % 50 AS s FROM orders),
 u AS (SELECT * FROM o WHERE n % 3 <> 2 OR is_table OR n NOT IN (SELECT n FROM o WHERE is_table)),
 m AS (SELECT u.n, path, label, s FROM u JOIN a ON u.n = a.n AND u.token = a.key) """


def _manifests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    order, n = F.col("o_orderkey"), F.col("o_orderkey") % 25
    is_table = (F.substring("o_orderpriority", 1, 1) == "1") & (n % 2 == 1)
    file = F.concat(F.lit("/d"), n, F.when(is_table, "/protocols/a.csv").otherwise("/protocols/b.txt"))
    orders = table(spark, sf_dir, "orders").select(
        file.alias("file"),
        F.concat(F.col("o_custkey").cast("string"), F.when(n.isin(4, 7), "x").otherwise("")).alias("token"),
        F.lit(None).cast("string").alias("last"),
        F.when(F.col("o_custkey") % 2 == 0, "fake").otherwise("real").alias("label"),
        F.array(F.struct((order % 50).cast("double").alias("s"), (order % 50 + 2).cast("double").alias("e"))).alias("segs"),
    )
    name = F.concat(F.when(F.col("c_custkey") % 4 == 0, "/dev/").otherwise("/train/"), "c_custkey", F.lit(".wav"))
    audio = table(spark, sf_dir, "customer").select(F.concat(F.lit("d"), "c_nationkey").alias("dataset"), F.concat(F.lit("/d"), "c_nationkey", name).alias("path"))
    files = audio.unionByName(orders.select(F.regexp_extract("file", "^/(d[0-9]+)/", 1).alias("dataset"), F.col("file").alias("path")).distinct())
    kind = F.get(F.array(*[F.lit(k) for k in ("add", "partial", "had")]), (F.col("n_nationkey") % 3).cast("int"))
    bases = table(spark, sf_dir, "nation").select(F.concat(F.lit("d"), "n_nationkey").alias("dataset"), kind.alias("kind"), F.concat(F.lit("/d"), "n_nationkey").alias("base"))
    return datasets.manifests(orders, files, bases)


@query(DATASETS + "SELECT DISTINCT 'd' || n AS dataset, 'train' AS subset, path, label FROM m UNION ALL SELECT 'd' || n, split, path, 'real' FROM a WHERE n % 3 = 1 AND n NOT IN (SELECT n FROM m)")
def dataset_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _manifests(spark, sf_dir)[0]


@query(DATASETS + "SELECT DISTINCT 'd' || n AS dataset, 'train' AS subset, path, s::DOUBLE AS start_sec, (s + 2)::DOUBLE AS end_sec FROM m WHERE label = 'fake'")
def dataset_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _manifests(spark, sf_dir)[1]
