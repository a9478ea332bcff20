"""Profiles: exact percentiles by counts, bins, intervals, calibration, entropy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def value_counts(df: DataFrame, keys: list[str], value: Column | str) -> DataFrame:
    """(keys, v, c): each value with its count, reduced before the shuffle."""
    return df.filter(tx.col(value).isNotNull()).groupBy(*keys, tx.col(value).alias("v")).agg(F.count("*").alias("c"))


def rank_percentiles(df: DataFrame, keys: list[str], value: Column | str, shares: dict[str, float], place: str) -> DataFrame:
    """Percentiles that are values of the data, by one of two rules for the place in rising order from 0.

    ``floor``: floor(n x share), at most n - 1. ``round``: (n - 1) x share, rounded half to even. Values are
    counted first, so a group costs as many rows as it has different values.
    """
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    own = value_counts(df, keys, value).withColumn("upto", F.sum("c").over(w.orderBy("v"))).withColumn("n", F.sum("c").over(w))
    at = lambda q: F.floor(F.col("n") * q) if place == "floor" else F.bround((F.col("n") - 1) * F.lit(q), 0)
    pick = [F.min(F.when(F.col("upto") > F.least(F.col("n") - 1, at(q)), F.col("v"))).alias(k) for k, q in shares.items()]
    return own.groupBy(*keys).agg(F.sum("c").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), *pick)


def linear_percentiles(df: DataFrame, keys: list[str], value: Column | str, shares: dict[str, float]) -> DataFrame:
    """Percentiles between values, from counted values."""
    own = value_counts(df, keys, value)
    return own.groupBy(*keys).agg(F.sum("c").alias("n"), *(F.round(F.percentile("v", F.lit(q), F.col("c")), 6).alias(k) for k, q in shares.items()))


def bins(value: Column, edges: list[tuple[str, float, float]]) -> Column:
    """The label of the first bin [low, high] that holds the value; null in none."""
    out = F.lit(None).cast("string")
    for label, low, high in reversed(edges):
        out = F.when((value >= low) & (value <= high), label).otherwise(out)
    return out


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Lower and upper bound of a share; null where n is 0."""
    n = n.cast("double")
    p = F.try_divide(hits.cast("double"), n)
    low = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / low
    rad = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / low
    ok = n > 0
    return F.when(ok, F.greatest(F.lit(0.0), mid - rad)), F.when(ok, F.least(F.lit(1.0), mid + rad))


def calibration_error(df: DataFrame, confidence: str, correct: str, n_bins: int = 10) -> DataFrame:
    """(ece): the mean gap of accuracy and confidence over bins [low, high), the last closed; other values drop out."""
    inside = F.when(F.col(confidence).between(0, 1), F.least(F.floor(F.col(confidence) * n_bins), F.lit(n_bins - 1)))
    by = df.groupBy(inside.alias("b")).agg(F.count("*").alias("k"), F.avg(F.col(correct).cast("double")).alias("acc"), F.avg(confidence).alias("conf"))
    gap = F.when(F.col("b").isNotNull(), F.col("k") * F.abs(F.col("acc") - F.col("conf")))
    return by.agg(F.round(F.coalesce(F.sum(gap) / F.sum("k"), F.lit(0.0)), 9).alias("ece"))


def unigram_entropy(tokens: DataFrame, token: str) -> DataFrame:
    """(tokens, vocabulary, entropy, perplexity) of the empirical distribution, in nats."""
    counts = tokens.groupBy(F.col(token).alias("_token")).agg(F.count("*").cast("double").alias("_c"))
    h = F.log(F.sum("_c")) - F.sum(F.col("_c") * F.log("_c")) / F.sum("_c")  # the same as -sum(p ln p), in one pass
    return counts.agg(F.sum("_c").cast("bigint").alias("tokens"), F.count("*").alias("vocabulary"), F.round(h, 6).alias("entropy"), F.round(F.exp(h), 4).alias("perplexity"))


def interval_union(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, windows, covered, total): how much the union of intervals [start, end) covers in each key."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    own = df.withColumn("_b", F.coalesce(before, F.col(start)))
    gain = F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), F.col("_b")))
    return own.groupBy(*keys).agg(F.count("*").alias("windows"), F.sum(gain).alias("covered"), F.sum(F.col(end) - F.col(start)).alias("total"))


def window_starts(n: Column, width: int, stride: int, tail_share: float = 0.5) -> Column:
    """Starts of windows over n tokens; a last one at the end if it stands far enough off. Empty under ``width``."""
    last = n - width
    own = F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(stride))
    least = -int(-(stride * tail_share) // 1)
    gap = last % stride
    return F.when(n < width, F.array().cast("array<int>")).when((gap > 0) & (gap >= least), F.array_append(own, last)).otherwise(own)
