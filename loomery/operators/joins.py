"""Joins the engine lacks: as-of, intervals, trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the newest right row of its keys at or before its time; null without one.

    One union and one window instead of a join by range. Of right rows at one time the greatest values hold.
    """
    a = left.withColumn("_t", F.col(left_time)).withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(_struct(right, values)))
    b = right.groupBy(*keys, F.col(right_time).alias("_t")).agg(F.max(F.struct(*values)).alias("_v")).withColumn("_side", F.lit(0))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).filter("_side = 1")
    return out.select(*left.columns, *(F.col(f"_v.{v}").alias(v) for v in values))


def _struct(df: DataFrame, names: list[str]) -> str:
    return "struct<" + ",".join(f"`{n}`:{df.schema[n].dataType.simpleString()}" for n in names) + ">"


def position_lookup(points: DataFrame, spans: DataFrame, point: str, start: str, size: str, value: str, width: int) -> DataFrame:
    """Each point with the value of the span [start, start + size) that holds it; null outside all spans.

    Spans don't overlap. Each is listed under every stretch of ``width`` it reaches into, which makes the join one
    by equality: spans + positions / width rows in all, no order over everything, nothing sent whole to all tasks.
    """
    last = F.floor((F.col(start) + F.col(size) - 1) / width)
    own = spans.filter(F.col(size) > 0).select(F.explode(F.sequence(F.floor(F.col(start) / width), last)).alias("_b"), F.col(start).alias("_s"), (F.col(start) + F.col(size)).alias("_e"), F.col(value).alias("_v"))
    at = points.withColumn("_b", F.floor(F.col(point) / width))
    inside = (at["_b"] == own["_b"]) & (F.col("_s") <= F.col(point)) & (F.col(point) < F.col("_e"))
    return at.join(own, inside, "left").select(*points.columns, F.col("_v").alias(value))


def tree_paths(nodes: DataFrame, id_col: str, parent_col: str, most_depth: int = 64) -> DataFrame:
    """(id, root, depth) of each node reached from a root (null parent), a level a round; cycles aren't reached."""
    level = materialize(nodes.filter(F.col(parent_col).isNull()).select(F.col(id_col).alias("id"), F.col(id_col).alias("root"), F.lit(0).alias("depth")), "tree")
    out = level
    edges = nodes.filter(F.col(parent_col).isNotNull()).select(F.col(id_col).alias("_c"), F.col(parent_col).alias("_p"))
    for d in range(1, most_depth + 1):
        level = materialize(edges.join(level, F.col("_p") == F.col("id")).select(F.col("_c").alias("id"), "root", F.lit(d).alias("depth")), "tree")
        if not level.head(1):
            break
        out = out.unionByName(level)
    return out


def positional(left: DataFrame, right: DataFrame, keys: list[str], compare: list[str]) -> DataFrame:
    """(keys, state): rows of two versions by position: same, changed, only_left, only_right."""
    a = left.select(*keys, F.struct(*compare).alias("_a"))
    b = right.select(*keys, F.struct(*compare).alias("_b"))
    state = F.when(F.col("_b").isNull(), "only_left").when(F.col("_a").isNull(), "only_right").when(F.col("_a").eqNullSafe(F.col("_b")), "same").otherwise("changed")
    return a.join(b, keys, "full_outer").select(*keys, state.alias("state"))


def raise_if(df: DataFrame, bad: Column, message: str) -> DataFrame:
    """The rows; reading them fails at the first that is bad."""
    return df.filter(F.coalesce(F.assert_true(~bad, F.lit(message)).isNull(), F.lit(True)))
