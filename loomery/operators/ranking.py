"""Ranking, quotas, samples and splits, all decided by hashes or ranks and so the same on every run."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def hash_score(seed: int, *parts: Column) -> Column:
    """Hex sha256 of ``seed:part:part``; as text it orders like the number."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts)), 256)


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int | Column, most: int | None = None) -> DataFrame:
    """The first n rows of each group. A fixed n (or ``most``, a bound of a varying n) limits each task's groups
    before the shuffle, so a group of a third of all rows doesn't meet in one task."""
    w = Window.partitionBy(*group).orderBy(*order)
    ranked = df.withColumn("_rn", F.row_number().over(w))
    if most is not None:
        ranked = ranked.filter(F.col("_rn") <= most)
    return ranked.filter(F.col("_rn") <= n).drop("_rn")


def capped(df: DataFrame, category: str, caps: dict[str, int], quota: int, order: list[Column]) -> DataFrame:
    """At most a cap of each category, then at most ``quota`` of all, in order; categories without a cap have the quota."""
    cap = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in caps.items() for x in kv)), F.coalesce(F.col(category), F.lit(""))), F.lit(quota)) if caps else F.lit(quota)
    inside = top_per_group(df.withColumn("_cap", cap), [category], order, F.col("_cap"), max(quota, *caps.values()) if caps else quota).drop("_cap")
    return inside.orderBy(*order).limit(quota)


def hamilton(weights: list[tuple[str, int]], target: int) -> dict[str, int]:
    """Quotas in proportion to weights: floors, then one each by largest remainder, larger weight, earlier place."""
    total = sum(w for _, w in weights)
    if not 0 <= target <= total:
        raise ValueError("the target lies between 0 and the sum of the weights")
    if not target:
        return {k: 0 for k, _ in weights}
    exact = [target * w / total for _, w in weights]
    out = [math.floor(x) for x in exact]
    by = sorted(range(len(weights)), key=lambda i: (-(exact[i] - out[i]), -weights[i][1], i))
    for i in by[: target - sum(out)]:
        out[i] += 1
    return {k: n for (k, _), n in zip(weights, out)}


def hamilton_quotas(counts: DataFrame, key: str, weight: str, target: Column) -> DataFrame:
    """(key, weight, quota) over a small table of weights, as ``hamilton`` but in the plan."""
    every = Window.partitionBy(F.lit(0))
    exact = target.cast("double") * F.col(weight) / F.sum(weight).over(every)
    own = counts.withColumn("_x", exact).withColumn("_f", F.floor("_x"))
    rank = F.row_number().over(every.orderBy((F.col("_x") - F.col("_f")).desc(), F.col(weight).desc(), F.col(key)))
    left = target - F.sum("_f").over(every)
    return own.select(key, weight, (F.col("_f") + F.when(rank <= left, 1).otherwise(0)).cast("bigint").alias("quota"))


def even_places(n: int, k: int) -> list[int]:
    """k places of 0..n-1 that keep both ends, rounded half to even."""
    return list(range(n)) if k >= n else [0] * min(k, 1) if k <= 1 else [round(i * (n - 1) / (k - 1)) for i in range(k)]


def spaced_places(n: int, k: int) -> list[int]:
    """The middle of each of k equal stretches of 0..n-1."""
    if not 0 < k <= n:
        raise ValueError("k lies between 1 and n")
    return [min(n - 1, int((i + 0.5) * n / k)) for i in range(k)]


def global_rank(df: DataFrame, order: list[str], partitions: int | None = None) -> DataFrame:
    """``rank`` from 0 in total order without one task for all rows: ranges, counts per range, prefix sums."""
    from ..session import materialize

    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranged = materialize(ranged.withColumn("_p", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_n"))  # one row a range
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_before")
    local = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return ranged.join(F.broadcast(before), "_p").withColumn("rank", (F.col("_before") + local).cast("bigint")).drop("_p", "_before")


def pick_places(df: DataFrame, order: list[str], places: list[int]) -> DataFrame:
    """The rows at the given places of the total order; places are few and known beforehand."""
    wanted = df.sparkSession.createDataFrame([(p,) for p in sorted(set(places))], "rank bigint")
    return global_rank(df, order).join(F.broadcast(wanted), "rank", "left_semi")


def exact_sample_places(n: int, k: int, seed: int) -> list[int]:
    """k places drawn by Python's generator: they depend on n, k and seed only, so rows needn't be read."""
    return sorted(random.Random(seed).sample(range(n), k))


def split_mod(key: Column, share: float) -> Column:
    """``validation`` for keys whose hash falls into the share, in millionths; equal keys stay together."""
    return F.when(tx.hash_mod(key, 1_000_000) < int(share * 1_000_000), "validation").otherwise("train")


def split_by_source(df: DataFrame, source: str, order: str, share: float, seed: int) -> DataFrame:
    """``split`` by a hash of seed and source; if one side stays empty, the first row's source goes there.

    Sources aren't spread over both sides. Ties of ``order`` go to the smaller source. Null sources are train.
    """
    bound = f"{int(share * (1 << 64)):016x}" if share < 1 else "g"
    hit = F.coalesce(tx.hash_fraction(F.col(source), seed) < bound, F.lit(False))
    # one row of three values decides whether a side stays empty
    known = df.filter(F.col(source).isNotNull()).agg(F.bool_or(hit).alias("any"), F.bool_and(hit).alias("all"), F.min(F.struct(order, source)).alias("f")).first()
    if known["f"] is not None and not known["any"]:
        hit = F.coalesce(F.col(source) == known["f"][source], F.lit(False))
    elif known["f"] is not None and known["all"]:
        hit = F.coalesce(F.col(source) != known["f"][source], F.lit(False))
    return df.withColumn("split", F.when(hit, "validation").otherwise("train"))


def stratified_anchors(df: DataFrame, stratum: Column, ratios: dict[str, float], target: int, id_col: str, seed: int) -> DataFrame:
    """``target`` rows: a quota of each stratum in hash order, what strata lack filled from all others in hash order.

    Each stratum has one first (where the target allows), then its share rounded down, then the rest in order.
    """
    base = 1 if target >= len(ratios) else 0
    quota = dict.fromkeys(ratios, base)
    left = target - sum(quota.values())
    if left > 0:
        for k, r in ratios.items():
            quota[k] += int(left * r)
        for k in ratios:
            if sum(quota.values()) >= target:
                break
            quota[k] += 1
    own = df.withColumn("stratum", stratum)
    own = own.withColumn("_h", hash_score(seed, F.coalesce("stratum", F.lit("any")), F.col(id_col)))
    limit = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in quota.items() for x in kv)), F.coalesce("stratum", F.lit(""))), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("stratum").orderBy("_h", id_col))
    most = max(target, *quota.values())
    own = own.withColumn("_limit", limit)
    inside = own.filter("stratum is not null").withColumn("_r", rank).filter(F.col("_r") <= most)
    taken = inside.filter("_r <= _limit").withColumn("_fill", F.lit(0))
    spare = inside.filter("_r > _limit").withColumn("_fill", F.lit(1))
    both = taken.unionByName(spare).orderBy("_fill", F.when(F.col("_fill") == 1, F.col("_h")), "stratum", "_h", id_col).limit(target)
    return both.drop("_h", "_limit", "_r", "_fill")


def spread_blocks(ranked: DataFrame, rank: str, count: int, block: int) -> DataFrame:
    """An even sample of at most ``count`` rows from blocks of ``block`` rows spread over all places (from 0)."""
    n = ranked.count()
    want = min(count, n)
    if want >= n or want <= 0:
        return ranked if want else ranked.limit(0)
    blocks, far = max(1, -(-want // block)), max(0, n - block)
    begins = sorted({0} if blocks == 1 else {round(i * far / (blocks - 1)) for i in range(blocks)})
    inside, held = F.lit(False), []
    for b in begins:
        inside = inside | F.col(rank).between(b, b + block - 1)
        held += [x for x in range(b, min(n, b + block)) if not held or x > held[-1]]  # at most blocks x block places
    k = min(want, len(held))
    picked = {len(held) // 2} if k == 1 else {round(i * (len(held) - 1) / (k - 1)) for i in range(k)}
    return ranked.filter(inside & F.col(rank).isin([held[i] for i in sorted(picked)]))


def rotating_pick(ranked: DataFrame, rank: str, count: int, offset: int) -> DataFrame:
    """``count`` picks in turn from the rows by place (from 0), begun at ``offset``: the rows with ``pick``; more picks than
    rows go round again."""
    n = ranked.count()
    if not n:
        return ranked.withColumn("pick", F.lit(None).cast("bigint")).limit(0)
    picks = ranked.sparkSession.range(count).select(F.col("id").alias("pick"), ((F.col("id") + offset) % n).alias("_r"))
    return ranked.join(picks, F.col(rank) == F.col("_r")).drop("_r")
