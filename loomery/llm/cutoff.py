"""Problem 3: the score cutoff per source that keeps a target share of its records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import plain_key


def keep_cutoffs(
    records: DataFrame, targets: DataFrame, source_col: str = "source", score_col: str = "score", percent_col: str = "keep_percent", partitions: int | None = None
) -> DataFrame:
    """(source, cutoff, kept_rows, all_rows): the highest score that keeps at least the target share.

    Equal scores of a source are counted before anything is shuffled, so a source or a score that
    holds a third of all rows is one row with a count. The counts are range-sorted by source and
    falling score; sums per (partition, source) and their prefix sums name the one partition in
    which a source's target falls, and only that partition's rows are read for the exact row.

    Null and blank-only sources, null and NaN scores don't count; a source without targets or without
    scores has no row. Sources are compared trimmed and in lower case. Of repeated targets the largest
    share holds; a share of 0 gives the highest score, a share above 100 the lowest.
    """
    spark = records.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = records.select(plain_key(source_col).alias("source"), F.col(score_col).cast("double").alias("score"))
    rows = rows.filter("source is not null and source <> '' and score is not null and not isnan(score)")
    counts = rows.groupBy("source", "score").agg(F.count("*").alias("n"))
    ranged = counts.repartitionByRange(n, F.col("source"), F.col("score").desc())
    ranged = materialize(ranged.withColumn("part", F.spark_partition_id()), "cutoff")
    wanted = targets.select(plain_key("source").alias("source"), F.col(percent_col).cast("double").alias("percent")).filter("source is not null and percent is not null")
    wanted = wanted.groupBy("source").agg(F.least(F.max("percent"), F.lit(100.0)).alias("percent"))

    # partition x source sums: at most partitions + sources rows
    by_part = ranged.groupBy("source", "part").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("source")
    sums = by_part.select("source", "part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("all_rows"))
    need = F.greatest(F.col("percent") * F.col("all_rows"), F.lit(1.0))
    target = sums.join(wanted, "source").filter((100 * F.col("before") < need) & (100 * (F.col("before") + F.col("n")) >= need))
    target = target.select("source", "part", "before", "all_rows", need.alias("need"))

    falling = Window.partitionBy("source", "part").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    # at most one row for each source that has a target
    exact = ranged.join(F.broadcast(target), ["source", "part"]).withColumn("kept_rows", F.col("before") + F.sum("n").over(falling))
    first = exact.filter((100 * F.col("kept_rows") >= F.col("need")) & (100 * (F.col("kept_rows") - F.col("n")) < F.col("need")))
    return first.select("source", F.col("score").alias("cutoff"), "kept_rows", "all_rows")
