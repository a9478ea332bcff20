"""Extras on streams: batches that drop what was seen before, and counts of event windows with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions import text as tx


def deduplicated(stream: DataFrame, text_col: str, time_col: str, late: str = "7 days") -> DataFrame:
    """Rows whose normalised text wasn't seen within ``late`` before; the state is bounded by the watermark."""
    keyed = stream.withColumn("_k", F.sha2(tx.dedupe_form(F.coalesce(text_col, F.lit(""))), 256))
    return keyed.withWatermark(time_col, late).dropDuplicatesWithinWatermark(["_k"]).drop("_k")


def seeded_batches(stream: DataFrame, text_col: str, seen_path: str, out_path: str, checkpoint: str) -> StreamingQuery:
    """Each batch against the digests of all before it: new rows go to ``out_path``, their digests to ``seen_path``.

    A batch that is run again writes its own folders anew, so nothing is doubled.
    """

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        keyed = batch.withColumn("digest", F.sha2(tx.dedupe_form(F.coalesce(text_col, F.lit(""))), 256)).dropDuplicates(["digest"])
        try:
            seen = spark.read.option("basePath", seen_path).parquet(seen_path).filter(F.col("batch") != n).select("digest")
            keyed = keyed.join(seen, "digest", "left_anti")
        except Exception as e:  # nothing was written yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
                raise
        keyed = keyed.persist()
        keyed.drop("digest").write.mode("overwrite").parquet(f"{out_path}/batch={n}")
        keyed.select("digest").write.mode("overwrite").parquet(f"{seen_path}/batch={n}")
        keyed.unpersist()

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def event_counts(stream: DataFrame, time_col: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by window and key; rows later than ``late`` are dropped."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, width), key).agg(F.count("*").alias("n"))
