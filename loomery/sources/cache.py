"""Caches of token ids in shards, stages that are run once, and the identity of what a table holds."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.ranking import global_rank
from ..operators.tokens import BOS, EOS, fill_shards
from ..session import materialize


def write_cache(docs: DataFrame, path: str, id_col: str, tokens_col: str, most: int, stretch: int | None = None) -> DataFrame:
    """Write documents' ids in shards of at most ``most`` tokens in the order of ``id_col``, no document split (a longer one
    has a shard of its own); returns (group, shard, documents, tokens). Null ids lists count as empty; ``id_col`` is unique.

    A row holds the document's begin in its shard, so that a shard is read as one run of tokens with its boundaries.
    """
    own = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(tokens_col), F.array().cast("array<int>")).alias("tokens"))
    placed = materialize(fill_shards(own.select("doc", F.size("tokens").alias("n")), "doc", "n", most, stretch), "places")
    w = Window.partitionBy("group", "shard").orderBy("doc").rowsBetween(Window.unboundedPreceding, -1)  # a shard is bounded
    placed = placed.withColumn("start", F.coalesce(F.sum("n").over(w), F.lit(0)).cast("bigint"))
    own.join(placed, "doc").select("group", "shard", "start", "doc", "tokens").write.mode("errorifexists").partitionBy("group").parquet(path)
    return placed.groupBy("group", "shard").agg(F.count("*").alias("documents"), F.sum("n").alias("tokens"))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """(group, shard, start, doc, tokens) of a written cache."""
    return spark.read.schema("shard int, start bigint, doc bigint, tokens array<int>, group bigint").parquet(path).select("group", "shard", "start", "doc", "tokens")


def cache_errors(cache: DataFrame, vocabulary: int, most: int, framed: bool = True) -> DataFrame:
    """(doc, code) of what is wrong with a cache: id_out_of_range, not_framed (no BOS and EOS around the ids), gap_or_overlap
    (a document doesn't begin where the one before ends) and shard_too_large. No row: it is sound."""
    w = Window.partitionBy("group", "shard").orderBy("start", F.size("tokens"))
    before = F.coalesce(F.lag(F.col("start") + F.size("tokens")).over(w), F.lit(0))
    alone = F.count("*").over(Window.partitionBy("group", "shard")) == 1
    t = F.col("tokens")
    own = cache.withColumns({"_gap": F.col("start") != before, "_big": (F.col("start") + F.size(t) > most) & ~alone})
    codes = F.array(
        F.when(F.exists(t, lambda x: (x < 0) | (x >= vocabulary) | x.isNull()), F.lit("id_out_of_range")),
        F.when(F.lit(framed) & ((F.size(t) < 2) | (F.get(t, F.lit(0)) != BOS) | (F.try_element_at(t, F.lit(-1)) != EOS)), F.lit("not_framed")),
        F.when(F.col("_gap"), F.lit("gap_or_overlap")),
        F.when(F.col("_big"), F.lit("shard_too_large")),
    )
    return own.select("doc", F.explode(F.array_compact(codes)).alias("code"))


def window_kept(mask: Column, policy: str = "any") -> Column:
    """Whether a window of 0 and 1 has enough that is 1: any, all, or more than half."""
    ones = F.aggregate(mask, F.lit(0), lambda a, x: a + x.cast("int"))
    if policy not in ("any", "all", "majority"):
        raise ValueError("policy is any, all or majority")
    return (F.size(mask) > 0) & {"any": ones > 0, "all": ones == F.size(mask), "majority": ones * 2 > F.size(mask)}[policy]


def fingerprint(settings: dict) -> str:
    """A digest of settings that doesn't depend on the order of their names."""
    return hashlib.sha256(json.dumps(settings, ensure_ascii=False, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def same_settings(a: dict, b: dict) -> None:
    """An error that names the settings in which an extension differs from what it extends."""
    other = sorted(k for k in {*a, *b} if a.get(k) != b.get(k))
    if other:
        raise ValueError("settings differ: " + ", ".join(f"{k} {a.get(k)!r} and {b.get(k)!r}" for k in other))


def stage(spark: SparkSession, folder: str, name: str, settings: dict, build: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """(table, whether it was there): what ``build`` gives, written once for each name and settings. A folder without the
    mark of a whole write, left by a run that was lost, is written again."""
    path = f"{folder.rstrip('/')}/{name}-{fingerprint(settings)[:20]}"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    there = mark.getFileSystem(conf).exists(mark)
    if not there:
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), there


def content_digest(df: DataFrame, order: list[str], block: int = 1000) -> DataFrame:
    """(rows, digest): a digest of all rows in the order given, by levels: of each row, of each ``block`` digests in
    order, and so on until one is left. Null for no row. Equal tables have equal digests however they are stored."""
    names = sorted(df.columns)
    row = F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256)
    own = global_rank(df.select(*order, row.alias("h")), order).select("rank", "h")
    n = left = own.count()
    while left > 1:
        own = own.groupBy(F.floor(F.col("rank") / block).cast("bigint").alias("rank")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "h"))), lambda x: x["h"]), ""), 256).alias("h"))
        own, left = materialize(own, "digests"), -(-left // block)
    return own.agg(F.lit(n).cast("bigint").alias("rows"), F.max("h").alias("digest"))


def preflight(pairs: DataFrame) -> DataFrame:
    """(split, rows, unusable, labelled, also_in_train): before a run, the rows of each split without a source or target,
    with reserved chat labels in either, and, outside train, whose source also stands in train."""
    own = pairs.select(F.lower(F.trim("split")).alias("split"), "source", "target", F.md5("source").alias("_h"))
    train = own.filter("split = 'train' and source is not null").select("_h").distinct().withColumn("_t", F.lit(True))
    bad = (tx.strip(F.coalesce("source", F.lit(""))) == "") | (tx.strip(F.coalesce("target", F.lit(""))) == "")
    label = F.regexp_like(F.concat_ws("\n", "source", "target"), F.lit(r"<\|[A-Za-z_]+\|>"))
    return own.join(train, "_h", "left").groupBy("split").agg(F.count("*").alias("rows"), F.count_if(bad).alias("unusable"), F.count_if(label).alias("labelled"), F.count_if((F.col("split") != "train") & F.col("_t")).alias("also_in_train"))
