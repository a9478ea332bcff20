"""Duplicates: exact, against a seed, by SimHash bands and by n-gram anchors."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import udfs
from ..session import materialize


def first_wins(df: DataFrame, digest: Column | str, order: list[str]) -> DataFrame:
    """The first row of each digest by ``order`` (unique), and every row without a digest.

    Rows are reduced before the shuffle, so a digest that a third of all rows hold costs one row a task.
    """
    names = df.columns
    own = F.concat_ws("\0", F.lit("row"), *(F.col(c).cast("string") for c in order))  # a key of its own for a row without digest
    keyed = df.withColumn("_d", F.coalesce(tx.col(digest), own))
    return keyed.groupBy("_d").agg(F.min_by(F.struct(*names), F.struct(*order)).alias("_r")).select("_r.*")


def mark_duplicates(df: DataFrame, digest: Column | str, order: list[str], salts: int = 32) -> DataFrame:
    """Every row with ``duplicate``: true for all but the first row of a digest. ``order`` must be unique.

    The first of each digest is found by pre-aggregation and brought back to the salted rows.
    """
    keyed = df.withColumn("_d", tx.col(digest)).withColumn("_o", F.struct(*order)).withColumn("_s", F.pmod(F.xxhash64("_o"), F.lit(salts)))
    part = keyed.filter("_d is not null").groupBy("_d", "_s").agg(F.min("_o").alias("_m"))
    first = part.groupBy("_d").agg(F.min("_m").alias("_first"))
    firsts = part.select("_d", "_s").join(first, "_d")
    out = keyed.join(firsts, ["_d", "_s"], "left")
    return out.withColumn("duplicate", F.coalesce(F.col("_o") != F.col("_first"), F.lit(False))).drop("_d", "_s", "_o", "_first")


def against_seed(df: DataFrame, digest: Column | str, seed: DataFrame) -> DataFrame:
    """Rows whose digest the seed (column ``digest``) doesn't hold; rows without a digest stay."""
    return df.withColumn("_d", tx.col(digest)).join(seed.select(F.col("digest").alias("_d")).distinct(), "_d", "left_anti").drop("_d")


def lexicographic_keep(edges: DataFrame) -> DataFrame:
    """(id) dropped: of edges (a < b), a row goes if an earlier kept row has an edge to it.

    Rounds decide all rows without an undecided earlier neighbour at once, until none is left; each round's
    edges are written to the shared folder. Chains need as many rounds as they are long.
    """
    spark = edges.sparkSession
    left = materialize(edges.select("a", "b").distinct(), "edges")
    gone = spark.createDataFrame([], left.select(F.col("b").alias("id")).schema)
    while left.head(1):
        # kept now: rows with no earlier neighbour among the edges left
        sure = left.select(F.col("a").alias("id")).distinct().join(left.select(F.col("b").alias("id")).distinct(), "id", "left_anti")
        out = materialize(left.join(sure, left.a == sure.id, "left_semi").select(F.col("b").alias("id")).distinct(), "gone")
        gone = gone.unionByName(out)
        hit = out.withColumnRenamed("id", "_x")
        rest = left.join(hit, left.b == hit._x, "left_anti").join(hit, left.a == hit._x, "left_anti")
        left = materialize(rest.join(sure, rest.a == sure.id, "left_anti"), "edges")
    return gone


def block_masks(threshold: int) -> list[int]:
    """All choices of three of threshold + 3 blocks of 64 bits, as signed masks."""
    n = threshold + 3
    edge = [64 * i // n for i in range(n + 1)]
    block = [((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1) for i in range(n)]
    found = [sum(c) for c in itertools.combinations(block, 3)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def simhash_near_duplicates(df: DataFrame, id_col: str, text_col: str, threshold: int = 3) -> DataFrame:
    """(id, class_id, duplicate): duplicate rows share 8 bits with, and differ in at most ``threshold`` bits from,
    an earlier kept row. Rows of one hash are one class, named by their smallest id, and compared once.

    Of threshold + 3 blocks of bits, three stand equal in every pair that counts: rows meet on three blocks at
    a time, about 32 bits for the usual threshold of 3, so chance meetings stay few among billions of rows.
    A text without letters hashes to all ones.
    """
    rows = df.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), udfs.simhash64(tx.dedupe_form(text_col)).alias("h"))
    rows = materialize(rows, "simhash")
    classes = materialize(rows.groupBy("h").agg(F.min("id").alias("class_id")), "hashes")
    keys = F.explode(F.array(*(F.struct(F.lit(i).alias("mask"), F.col("h").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(block_masks(threshold)))))
    cut = classes.withColumn("_b", keys).select("class_id", "h", "_b.mask", "_b.v")
    other = cut.select(F.col("class_id").alias("b"), F.col("h").alias("h2"), "mask", "v")
    near = (F.bit_count(F.col("h").bitwiseXOR(F.col("h2"))) <= threshold) & (F.col("class_id") < F.col("b"))
    edges = cut.join(other, ["mask", "v"]).filter(near).select(F.col("class_id").alias("a"), "b").distinct()
    gone = lexicographic_keep(edges).withColumnRenamed("id", "class_id").withColumn("_gone", F.lit(True))
    out = rows.join(classes, "h").join(gone, "class_id", "left")
    return out.select(F.col("id").alias(id_col), "class_id", (F.coalesce("_gone", F.lit(False)) | (F.col("id") != F.col("class_id"))).alias("duplicate"))


#: Counters of how many corpus texts hold a 4-gram, by its hash; whatever the corpus holds, there are no more.
COUNTERS = 1 << 20


def _gram_hashes(texts: list[str]):
    """Of each text the distinct hashes of its 4-grams (of the whole text, if it is shorter)."""
    for t in texts:
        cp = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n = max(1, len(cp) - 3)
        h = np.zeros(n, np.uint64)
        for j in range(min(4, len(cp))):
            h = (h ^ cp[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        yield np.unique(h)


def anchor_overlap(queries: DataFrame, corpus: DataFrame, id_a: str, id_b: str, text_a: str, text_b: str, least: float = 0.85) -> DataFrame:
    """(id_a, best_id, jaccard): for each query text the most similar corpus text by 4-gram sets, from ``least`` on.

    No candidate is cut off. Copies of a corpus text are one, named by their smallest id, and query texts of one set
    are compared once. Queries and corpus texts without letters have no row; equal similarities go to the smaller id.

    A set that the corpus holds too has its answer at once. The others meet on their anchors: with all 4-grams in one
    order, two sets that reach ``least`` share one among the first (1 - least) of either. The order is by how many
    corpus texts hold a 4-gram's hash, counted in COUNTERS counters, so texts meet on what is rare and not on
    boilerplate. From the first anchor two sets share on, both must have as many 4-grams left as they need to share.
    What is left is compared by whole sets.
    """
    spark = queries.sparkSession
    grams = lambda f: F.array_distinct(tx.char_ngrams(f, 4, whole_if_short=True))
    digest = lambda g: F.unhex(F.sha2(F.array_join(F.array_sort(g), "\0"), 256))

    def read(df: DataFrame, key: str, text: str) -> DataFrame:
        own = df.select(F.col(key).alias("id"), tx.dedupe_form(text).alias("f")).filter("f <> ''")
        return own.select("id", "f", digest(grams("f")).alias("h"))

    own = materialize(read(queries, id_a, text_a), "queries")
    c = materialize(read(corpus, id_b, text_b).groupBy("h").agg(F.min("id").alias("cb"), F.min("f").alias("fb")), "corpus")
    q = own.groupBy("h").agg(F.min("id").alias("q"), F.min("f").alias("fa"))
    q = materialize(q.join(c.select("h", "cb"), "h", "left"), "classes")
    same = q.filter("cb is not null").select("q", F.struct("cb", F.lit(1.0).alias("j")).alias("m"))
    ask = q.filter("cb is null").select("q", "fa")

    def counted(batches):
        total = np.zeros(COUNTERS, np.int64)
        for b in batches:
            for h in _gram_hashes(b.column(0).to_pylist()):
                np.add.at(total, (h % np.uint64(COUNTERS)).astype(np.int64), 1)
        hot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hot), pa.array(total[hot])], names=["k", "n"])

    table = c.select("fb").mapInArrow(counted, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toArrow()  # at most COUNTERS rows
    often = np.zeros(COUNTERS, np.int32)
    often[table.column("k").to_numpy()] = np.minimum(table.column("n").to_numpy(), 2**31 - 1)
    shared = spark.sparkContext.broadcast(often)

    def anchored(df: DataFrame, key: str, text: str, end: str) -> DataFrame:
        """(key, 4-grams from the anchor on, size, anchor): a row for each 4-gram that a pair may meet on."""

        def run(batches):
            for b in batches:
                ids, size, rest, found = [], [], [], []
                for i, h in enumerate(_gram_hashes(b.column(1).to_pylist())):
                    first = np.lexsort((h, shared.value[(h % np.uint64(COUNTERS)).astype(np.int64)]))[: int(len(h) * (1 - least) + 1e-6) + 1]
                    ids.append(np.full(len(first), i))
                    size.append(np.full(len(first), len(h), np.int32))
                    rest.append(np.arange(len(h), len(h) - len(first), -1, dtype=np.int32))
                    found.append(h[first].view(np.int64))
                if ids:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.concatenate(ids))), pa.array(np.concatenate(size)), pa.array(np.concatenate(rest)), pa.array(np.concatenate(found))], names=[key, f"n{end}", f"r{end}", "k"])

        return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, n{end} int, r{end} int, k bigint")

    both = (F.col("na") + F.col("nb")) * (least / (1 + least)) - 1e-6  # 4-grams that a pair must share
    hits = anchored(ask, "q", "fa", "a").join(anchored(c, "cb", "fb", "b"), "k").filter(F.least("ra", "rb") >= both).select("q", "cb").distinct()
    scored = hits.join(ask, "q").join(c.select("cb", "fb"), "cb").select("q", "cb", F.round(tx.jaccard(grams("fa"), grams("fb")), 9).alias("j")).filter(F.col("j") >= least)
    best = scored.groupBy("q").agg(F.max_by(F.struct("cb", "j"), F.struct("j", -F.col("cb"))).alias("m")).unionByName(same)
    return own.join(q.select("h", "q"), "h").join(best, "q").select(F.col("id").alias(id_a), F.col("m.cb").alias("best_id"), F.col("m.j").alias("jaccard"))
