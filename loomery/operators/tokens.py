"""Tokens: characters as ids, packing in order, shards, coverage."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

#: Ids with a meaning of their own.
PAD, BOS, EOS, UNK = 0, 1, 2, 3


def char_vocabulary(docs: DataFrame, text_col: str, most: int | None = 60_000) -> DataFrame:
    """(char, id): the ``most`` commonest characters (None: all), ids from 4 on by falling count, then by character.

    Unicode bounds the rows, whatever the corpus holds.
    """
    chars = docs.select(F.explode(F.split(text_col, "")).alias("char")).filter("char <> ''").groupBy("char").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.orderBy(F.col("n").desc(), "char"))
    own = chars if most is None else chars.orderBy(F.col("n").desc(), "char").limit(most)
    return own.select("char", (rank + 3).cast("int").alias("id"))


def encode_chars(docs: DataFrame, vocabulary: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tokens): BOS, the characters' ids (UNK for others) and EOS. Null texts count as empty.

    The vocabulary, which Unicode bounds, goes to all tasks; ids are looked up by code point.
    """
    codes = vocabulary.select(F.col("char"), F.col("id")).toArrow()
    cp = np.frombuffer("".join(codes.column("char").to_pylist()).encode("utf-32-le"), np.uint32)
    ids = codes.column("id").to_numpy().astype(np.int32)
    own = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))

    def run(batches):
        code = np.full(0x110000, UNK, np.int32)
        code[cp] = ids
        for b in batches:
            texts = b.column(1).to_pylist()
            size = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
            end = np.cumsum(size)
            out = np.full(int(size.sum()), EOS, np.int32)
            out[end - size] = BOS
            inner = np.ones(len(out), bool)
            inner[end - size] = inner[end - 1] = False
            out[inner] = code[np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)]
            at = pa.array(np.concatenate([[0], end]), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(at, pa.array(out))], names=[id_col, "tokens"])

    return own.mapInArrow(run, f"`{id_col}` {own.schema[id_col].dataType.simpleString()}, tokens array<int>")


def decode_chars(encoded: DataFrame, vocabulary: DataFrame, id_col: str, tokens_col: str = "tokens") -> DataFrame:
    """(id, text) of encoded characters: PAD, BOS and EOS are passed over, UNK and other ids without a character become the
    replacement character. Null lists give an empty text."""
    codes = vocabulary.select("char", "id").toArrow()  # Unicode bounds the rows
    cp = np.frombuffer("".join(codes.column("char").to_pylist()).encode("utf-32-le"), np.uint32)
    ids = codes.column("id").to_numpy().astype(np.int64)
    char = np.full(int(ids.max()) + 1 if len(ids) else 4, 0xFFFD, np.uint32)
    char[ids] = cp

    def run(batches):
        for b in batches:
            texts = []
            for t in b.column(1).to_pylist():
                x = np.asarray(t or [], np.int64)
                x = x[(x != PAD) & (x != BOS) & (x != EOS)]
                texts.append(np.where((x >= 0) & (x < len(char)), char[np.clip(x, 0, len(char) - 1)], 0xFFFD).astype(np.uint32).tobytes().decode("utf-32-le"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return encoded.select(id_col, tokens_col).mapInArrow(run, f"`{id_col}` {encoded.schema[id_col].dataType.simpleString()}, text string")


def fit_length(tokens: Column, most: int, fill: bool = False) -> Column:
    """At most ``most`` ids, the last of a cut list EOS; ``fill`` makes shorter ones up with PAD."""
    cut = F.when(F.size(tokens) > most, F.concat(F.slice(tokens, 1, most - 1), F.array(F.lit(EOS)))).otherwise(tokens)
    return tx.let(cut, lambda t: F.concat(t, F.array_repeat(F.lit(PAD), F.greatest(F.lit(most) - F.size(t), F.lit(0))))) if fill else cut


def running_starts(docs: DataFrame, order: str, size: str) -> DataFrame:
    """The rows with ``start``, the sum of sizes before them in the total order, without one task for all rows."""
    from ..session import materialize

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(docs.repartitionByRange(n, order).withColumn("_p", F.spark_partition_id()), "starts")
    sums = ranged.groupBy("_p").agg(F.sum(size).alias("_n"))
    before = sums.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    local = F.coalesce(F.sum(size).over(Window.partitionBy("_p").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.join(F.broadcast(before), "_p").withColumn("start", (F.col("_before") + local).cast("bigint")).drop("_p", "_before")


def fill_shards(docs: DataFrame, order: str, size: str, most: int, stretch: int | None = None) -> DataFrame:
    """(order, size, group, shard): in order, the next shard begins where a document would pass ``most``; none is split.

    Filling in order is a chain, so the order is cut into stretches of ``stretch`` tokens (by where a document begins;
    1,000 shards' worth by default) that are filled apart: as many tasks as the tokens need, none larger than that.
    Null sizes count as 0. ``order`` must be unique.
    """
    stretch = stretch or 1000 * most
    own = docs.select(F.col(order).alias(order), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias(size))
    rows = running_starts(own, order, size).withColumn("group", F.floor(F.col("start") / stretch).cast("bigint"))
    kind = docs.schema[order].dataType.simpleString()

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order, kind="stable")
        out, shard, used = np.zeros(len(g), np.int32), 0, 0
        for i, n in enumerate(g[size].to_numpy(np.int64)):
            if used and used + n > most:
                shard, used = shard + 1, 0
            used += int(n)
            out[i] = shard
        return g[[order, size, "group"]].assign(shard=out)

    return rows.groupBy("group").applyInPandas(run, f"`{order}` {kind}, `{size}` bigint, group bigint, shard int")


def first_fit(docs: DataFrame, id_col: str, size: str, group: Column, width: int) -> DataFrame:
    """(group, id, window, offset, n): each document in the first open window of its group it fits in, by id.

    A document wider than the window is cut into windows of its own. Groups are packed apart and must be of
    bounded size; a hash of the id makes such groups.
    """
    own = docs.select(group.cast("int").alias("group"), F.col(id_col).alias("id"), F.coalesce(F.col(size), F.lit(0)).cast("int").alias("n"))
    shape = f"group int, id {docs.schema[id_col].dataType.simpleString()}, window int, offset int, n int"

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id", kind="stable")
        size, tree = 1, None
        while size < max(1, int((g["n"] // width + 1).sum())):
            size *= 2
        tree = np.full(2 * size, width, np.int64)  # most room below each node of a tree over the windows
        out = []
        for doc, n in zip(g["id"], g["n"]):
            for part in [width] * (n // width) + ([n % width] if n % width else []):
                i = 1
                while i < size:
                    i = 2 * i if tree[2 * i] >= part else 2 * i + 1
                out.append((int(g["group"].iloc[0]), doc, i - size, width - int(tree[i]), part))
                tree[i] -= part
                while i > 1:
                    i //= 2
                    tree[i] = max(tree[2 * i], tree[2 * i + 1])
        return pd.DataFrame(out, columns=["group", "id", "window", "offset", "n"])

    return own.groupBy("group").applyInPandas(run, shape)


def target_mask(documents: Column) -> Column:
    """1 for each place after which the same document goes on: targets that cross documents are masked."""
    return tx.let(documents, lambda d: F.transform(F.sequence(F.lit(1), F.greatest(F.size(d) - 1, F.lit(1))), lambda i: (F.element_at(d, i) == F.try_element_at(d, i + 1)).cast("int")))


def boundary_settings(config: dict) -> dict:
    """Which documents attention and targets may cross, from a policy name or from the older switches.

    ``document_boundary_policy`` is none, label_only, strict (strict_dense), strict_varlen or single_doc_windows. An older
    ``document_attention`` that says otherwise is an error; without a policy it and ignore_cross_document_targets decide.
    """
    names = {"none": "none", "label_only": "label_only", "strict": "strict", "strict_dense": "strict", "strict_varlen": "strict_varlen", "single_doc_windows": "single_doc_windows"}
    given, old = config.get("document_boundary_policy"), config.get("document_attention")
    if given is not None:
        policy = names.get(str(given).strip().lower())
        if policy is None:
            raise ValueError(f"unknown document_boundary_policy {given!r}")
        attention = policy.startswith("strict")
        if old is not None and bool(old) != attention:
            raise ValueError("document_boundary_policy and document_attention disagree")
        ignore = bool(config.get("ignore_cross_document_targets", policy != "none"))
        return {"policy": policy, "document_attention": attention, "ignore_cross_document_targets": ignore, "single_document_windows": policy == "single_doc_windows"}
    attention, ignore = bool(True if old is None else old), bool(config.get("ignore_cross_document_targets", True))
    return {"policy": "strict" if attention else "label_only" if ignore else "none", "document_attention": attention, "ignore_cross_document_targets": ignore, "single_document_windows": False}


def language_windows(tokens: Column, width: int, stride: int | None = None, pad: int = PAD) -> Column:
    """Windows of width + 1 tokens, padded, one each ``stride`` until one reaches the end; null for null, and a text of at
    most that many tokens is one window. Inputs are all but a window's last token, targets all but its first."""
    step, size = stride or width, width + 1

    def cut(t: Column) -> Column:
        many = F.when(F.size(t) <= size, F.lit(1)).otherwise(F.ceil((F.size(t) - size) / step).cast("int") + 1)
        own = F.transform(F.sequence(F.lit(0), many - 1), lambda i: F.slice(t, i * step + 1, size))
        return F.transform(own, lambda w: F.concat(w, F.array_repeat(F.lit(pad).cast("int"), size - F.size(w))))

    return F.when(tokens.isNotNull(), tx.let(tokens, cut))


def window_targets(window: Column, pad: int = PAD, ignore: int = -100) -> Column:
    """The targets of a window: its tokens from the second on, ``ignore`` in place of padding."""
    return F.transform(F.slice(window, 2, F.greatest(F.size(window) - 1, F.lit(0))), lambda x: F.when(x == pad, F.lit(ignore)).otherwise(x))


def boundary_stats(starts: DataFrame, start: str, size: str, width: int, stride: int) -> DataFrame:
    """One row on windows of ``width`` tokens each ``stride`` over all documents put together: windows, those that hold
    the begin of another document behind their first token, and targets whose document isn't that of their input.

    Each document's begin lies in at most width / stride windows, which are found from its place.
    """
    n = starts.agg(F.max(F.col(start) + F.col(size))).first()[0] or 0
    many = max((n - width) // stride + 1, 0)
    first = lambda s: F.greatest(F.ceil((s - width + 1) / stride), F.lit(0))
    inner = starts.filter((F.col(start) > 0) & (F.col(size) > 0)).select(F.col(start).alias("s")).distinct()
    hit = inner.select(first(F.col("s")).cast("bigint").alias("a"), F.least(F.floor((F.col("s") - 1) / stride), F.lit(many - 1)).cast("bigint").alias("b")).filter("a <= b").select(F.explode(F.sequence("a", "b")).alias("w"))
    per = hit.groupBy("w").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("crossing_windows"), F.coalesce(F.sum("n"), F.lit(0)).alias("crossing_targets")).select(F.lit(many).cast("bigint").alias("windows"), F.lit(many * (width - 1)).cast("bigint").alias("targets"), "crossing_windows", "crossing_targets")
