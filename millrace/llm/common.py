"""What the operators share: the shared folder, intermediate tables and batch sizes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: blank and \t \n \v \f \r.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local one only where that is unset, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table, written to the shared folder and read back: nothing before it is computed again, whatever executor is lost."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of stored() tables that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/millrace/" in path:
                where = spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """For narrow tables of iterative jobs: a reliable checkpoint. Its files stay until the shared folder is cleared, or Spark's
    cleaner removes them where spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Arrow batches of few rows: a batch of very long texts still fits a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone; lower() would also change other letters, and lengths with them."""
    return F.translate(c, UPPER, LOWER)


def hash128(c: Column, name: str) -> list[Column]:
    """Two independent 64-bit hashes of a string, as two columns: together too wide for chance collisions of a whole corpus."""
    return [F.xxhash64(c).alias(f"{name}a"), F.xxhash64(F.lit(1), c).alias(f"{name}b")]


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns alone, cast to the types given: extra columns of the input, whatever their names, do not matter."""
    return df.select(*[F.col(f"`{k}`").cast(v).alias(k) for k, v in columns.items()])
