"""Session helpers: where lineage is cut and how tables are found."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only where the setting is absent and Spark runs in this process (tests, single machine) a temporary folder is made;
    on a cluster its absence is an error, for executors would each write to a disk of their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="loomery-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def materialize(df: DataFrame, what: str = "t") -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it again.

    A written table survives the loss of executors and is stored once, by column.
    """
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder name in the shared folder; ``release`` deletes what was written there."""
    path = f"{shared_dir(spark)}/loomery-{what}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete the tables that this process cut lineages with, once no result that reads them is needed; how many there were."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    n = len(_WRITTEN)
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)
    return n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder.

    A table that lies in fewer splits than half the cores (one small file of one row group) is spread over them;
    tables of ordinary size are read as they lie, without a shuffle.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if 2 * df.rdd.getNumPartitions() <= cores and _rows_known(df) > 1000:
        df = df.repartition(cores)
    return df


def _rows_known(df: DataFrame) -> int:
    """A guess of the rows from the files' size, without reading them."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // 100
