"""Problem 8: items into containers of fixed capacity, best fit with conflicts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import small_rows
from .tokenize import count_tokens

#: Rows packed together in one group; what a group leaves open is at most its last containers.
SHARD_ROWS = 25_000


class Bins:
    """Open containers, ordered by what is left in them, each with bitmaps of its sources and clusters."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.left: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.by_left: dict[int, list[int]] = {}
        self.filled = 0  # bit r: some container has r left

    def open(self) -> int:
        self.left.append(self.capacity)
        self.sources.append(0)
        self.clusters.append(0)
        self._file(len(self.left) - 1)
        return len(self.left) - 1

    def _file(self, b: int) -> None:
        r = self.left[b]
        self.by_left.setdefault(r, []).append(b)
        self.filled |= 1 << r

    def candidates(self, size: int, cluster: int, source: int):
        """Compatible containers from the tightest on: neither bitmap may hold the item's bit."""
        rest = self.filled >> size << size
        while rest:
            low = rest & -rest
            rest ^= low
            for b in self.by_left.get(low.bit_length() - 1, ())[::-1]:
                if not (self.clusters[b] & cluster or self.sources[b] & source):
                    yield b

    def put(self, b: int, size: int, cluster: int, source: int) -> None:
        if size:
            r = self.left[b]
            same = self.by_left[r]
            if same[-1] == b:
                same.pop()
            else:
                same.remove(b)
            if not same:
                del self.by_left[r]
                self.filled ^= 1 << r
            self.left[b] = r - size
            self._file(b)
        self.sources[b] |= source
        self.clusters[b] |= cluster


#: Of one source a container takes so many times as many items as an even spread would give it.
SOURCE_SLACK = 2


def pack(sizes: np.ndarray, clusters: np.ndarray, sources: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item, from the largest item on; no size may exceed ``capacity``.

    Items with the same bit never share a container. Copies of a text have a bit each in turn, of as many as an even
    spread over the least possible number of containers puts into one (one, unless there are more copies than
    containers); so have items of a source, of SOURCE_SLACK times as many. An item that no open container can take
    opens a new one; only where there are as many as the sizes need at least, and the source alone is in the way,
    does it go to the tightest container without regard to the source. Items of size 0 go to container 0.
    """
    n = len(sizes)
    where = np.zeros(n, np.int64)
    if not n:
        return where
    least = max(1, -(-int(sizes.sum()) // capacity))
    some = sizes > 0
    bits = []
    for values, slack in ((clusters, 1), (sources, SOURCE_SLACK)):
        _, of = np.unique(values, return_inverse=True)
        many = np.bincount(of[some], minlength=int(of.max()) + 1)
        bits.append((of, many, np.maximum(1, slack * -(-many // least))))
    (of, many, share), (src, src_many, src_share) = bits
    seen, src_seen = [0] * len(many), [0] * len(src_many)
    bit_of: tuple[dict, dict] = ({}, {})
    bins = Bins(capacity)
    order = np.lexsort((np.arange(n), of, -sizes))
    run_key, run = None, iter(())
    for i in order.tolist():
        size, c, s = int(sizes[i]), int(of[i]), int(src[i])
        if not size:
            if not bins.left:
                bins.open()
            continue
        bit = source = 0
        if many[c] > 1:
            bit = bit_of[0].setdefault((c, seen[c] % int(share[c])), 1 << len(bit_of[0]))
            seen[c] += 1
        if src_many[s] > 1:
            source = bit_of[1].setdefault((s, src_seen[s] % int(src_share[s])), 1 << len(bit_of[1]))
            src_seen[s] += 1
        if bit and run_key == (size, bit, source):
            b = next(run, None)  # goes on where the last copy was put: what is tighter holds a copy by now
        else:
            run_key, run = (size, bit, source), bins.candidates(size, bit, source)
            b = next(run, None)
        if b is None and source and len(bins.left) >= least:
            b = next(bins.candidates(size, bit, 0), None)
        if b is None:
            b = bins.open()
        bins.put(b, size, bit, source)
        if not bit:
            run_key = None
        where[i] = b
    return where


def pack_texts(docs: DataFrame, containers: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", path: str | None = None) -> DataFrame:
    """(container, capacity, bin_id, id, piece, token_start, n_tokens): every text in a container of each capacity.

    A text larger than the capacity fills containers of its own and its rest is an item like any other; no
    other text is split. Null and empty texts have 0 tokens and take no space. Repeated rows are packed as
    often as they occur. Ids may repeat or be null; rows of ``containers`` with a null or non-positive
    capacity are left out, of a container's several capacities the largest holds.

    Sizes are counted once and stored. Groups of about SHARD_ROWS items, by a hash of the row, are packed
    apart from one another, so no task grows with the corpus; each leaves at most its last containers open.
    """
    named = containers.select(F.col("container").alias("container"), F.col("capacity").cast("int").alias("capacity")).filter("capacity > 0")
    kinds = [(r[0], r[1]) for r in small_rows(named.groupBy("container").agg(F.max("capacity").alias("capacity")), 1000)]
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.coalesce(F.col(source_col), F.lit("")).alias("_source"), F.xxhash64(text_col, F.length(text_col)).alias("_cluster"))
    sized = materialize(count_tokens(base, "_text", path, ("_id", "_source", "_cluster")), "sizes")
    shards = max(1, -(-sized.count() // SHARD_ROWS))
    item = F.explode(F.array(*(F.struct(F.lit(c).alias("container"), F.lit(k).alias("capacity")) for c, k in kinds)))
    many = sized.withColumn("_kind", item).withColumn("_shard", F.pmod(F.xxhash64("_id", "n_tokens", "_cluster"), F.lit(shards)).cast("int"))
    many = many.select("_kind.container", "_kind.capacity", "_shard", "_id", "_source", "_cluster", "n_tokens")
    many = many.repartition(shards * max(1, len(kinds)), "container", "_shard")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        cap, shard = int(g["capacity"].iloc[0]), int(g["_shard"].iloc[0])
        g = g.sort_values(["_cluster", "_id", "n_tokens"], kind="stable").reset_index(drop=True)
        size = g["n_tokens"].to_numpy(np.int64)
        full, rest = size // cap, size % cap
        has_rest = (rest > 0) | (size == 0)
        where = pack(rest[has_rest], g["_cluster"].to_numpy()[has_rest], g["_source"].to_numpy()[has_rest], cap)
        used = int(where.max()) + 1 if len(where) else 0
        row = np.repeat(np.arange(len(g)), full)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(full) - full, full)
        rows = np.concatenate([row, np.flatnonzero(has_rest)])
        piece = np.concatenate([nth, full[has_rest]])
        return pd.DataFrame({
            "container": g["container"].iloc[0], "capacity": np.int32(cap),
            "bin_id": (np.int64(shard) << 32) + np.concatenate([used + np.arange(len(row)), where]),
            id_col: g["_id"].take(rows).to_numpy(), "piece": piece.astype(np.int32), "token_start": (piece * cap).astype(np.int32),
            "n_tokens": np.concatenate([np.full(len(row), cap), rest[has_rest]]).astype(np.int32),
        })

    kind = docs.schema[id_col].dataType.simpleString()
    shape = f"container string, capacity int, bin_id bigint, `{id_col}` {kind}, piece int, token_start int, n_tokens int"
    return many.groupBy("container", "_shard").applyInPandas(run, shape)
