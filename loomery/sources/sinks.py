"""Writers: shards with digests and a manifest, tables by key, fixed-size shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_shards(df: DataFrame, path: str, most_rows: int) -> DataFrame:
    """JSON lines of at most ``most_rows`` a file; returns (file, rows, bytes, sha256) of what was written.

    An existing folder is an error; the commit protocol shows the files only once all are whole.
    """
    df.write.mode("errorifexists").option("maxRecordsPerFile", most_rows).json(path)
    return manifest(df.sparkSession, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, rows, bytes, sha256) of a folder's files; each is read whole, so shards must fit a task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json*").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.regexp_count(F.col("content").cast("string"), F.lit("\n")).cast("bigint").alias("rows"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """(file, state): same, changed, missing or unexpected against an earlier manifest."""
    now = manifest(spark, path).select("file", F.col("sha256").alias("_n"))
    old = expected.select("file", F.col("sha256").alias("_o"))
    state = F.when(F.col("_o").isNull(), "unexpected").when(F.col("_n").isNull(), "missing").when(F.col("_o") == F.col("_n"), "same").otherwise("changed")
    return now.join(old, "file", "full_outer").select("file", state.alias("state"))


def write_by(df: DataFrame, path: str, key: str) -> None:
    """A folder a key; what earlier runs left is gone. Rows of a key are spread over tasks as they lie."""
    df.write.mode("overwrite").partitionBy(key).json(path)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def sequential_shards(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """The rows with ``shard`` and ``place`` in it, ``size`` rows a shard in total order."""
    from ..operators.ranking import global_rank

    own = global_rank(df, order)
    return own.withColumn("shard", F.floor(F.col("rank") / size).cast("bigint")).withColumn("place", (F.col("rank") % size).cast("int")).drop("rank")


def round_robin(df: DataFrame, order: list[str], parts: int) -> DataFrame:
    """The rows with ``part``, their place in total order modulo ``parts``."""
    from ..operators.ranking import global_rank

    return global_rank(df, order).withColumn("part", (F.col("rank") % parts).cast("int")).drop("rank")
