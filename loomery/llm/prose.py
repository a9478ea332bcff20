"""Problem 1: text statistics, and a mixture model that tells prose from lists, tables and junk."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .bpe import blocks
from .common import plain_key, small_rows
from .examples import EXAMPLES
from .textstats import BASIC, MORE, Lexicon, batch_stats

#: Components of the mixture, and the least variance of a standardized statistic in one.
COMPONENTS, FLOOR = 96, 0.3
#: Rows, those with the least hashes of their ids, on which the mixture starts; the rounds after that see all rows.
START_ROWS = 20_000
#: EM ends when a round adds less than this to the mean log-likelihood of a row.
GAIN = 5e-3
#: Characters of texts whose statistics are worked out together.
BATCH_CHARS = 400_000
KINDS = ["prose", "list", "table", "junk"]


class Mixture:
    """Gaussians with diagonal covariance over standardized statistics."""

    def __init__(self, weight: np.ndarray, mean: np.ndarray, var: np.ndarray):
        self.weight, self.mean, self.var = weight, mean, var

    def density(self, x: np.ndarray) -> np.ndarray:
        """Of standardized rows: the logarithm of each component's share of the density."""
        inv = 1 / self.var
        const = (self.mean * self.mean * inv).sum(1) + np.log(self.var).sum(1) - 2 * np.log(self.weight)
        return -0.5 * ((x * x) @ inv.T - 2 * x @ (self.mean * inv).T + const)

    def expect(self, x: np.ndarray) -> np.ndarray:
        """Sums of one E-step: responsibilities, these times the rows and their squares, and the log-likelihood."""
        log = self.density(x)
        top = log.max(1, keepdims=True)
        p = np.exp(log - top)
        total = p.sum(1, keepdims=True)
        p /= total
        return np.concatenate([p.sum(0), (p.T @ x).ravel(), (p.T @ (x * x)).ravel(), [(np.log(total) + top).sum()]])

    def maximize(self, sums: np.ndarray) -> Mixture:
        k, d = self.mean.shape
        nk, sx, sxx = sums[:k], sums[k : k + k * d].reshape(k, d), sums[k + k * d : -1].reshape(k, d)
        some = np.maximum(nk, 1e-6)[:, None]
        mean = np.where(nk[:, None] > 1e-6, sx / some, self.mean)  # a component that has lost its rows stays where it is
        var = np.where(nk[:, None] > 1e-6, sxx / some - mean**2, self.var)
        return Mixture(np.maximum(nk, 1e-6) / np.maximum(nk, 1e-6).sum(), mean, np.maximum(var, FLOOR))


def spread_rows(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """At most k rows, each drawn by its squared distance from those before."""
    rows = [x[rng.integers(len(x))]]
    d = ((x - rows[0]) ** 2).sum(1)
    while len(rows) < k and d.sum() > 1e-9:
        rows.append(x[rng.choice(len(x), p=d / d.sum())])
        d = np.minimum(d, ((x - rows[-1]) ** 2).sum(1))
    return np.array(rows)


def start_mixture(x: np.ndarray, k: int = COMPONENTS, seed: int = 4, rounds: int | None = None) -> Mixture:
    """EM on the rows given, begun at rows drawn from them, until a round gains less than GAIN (or for ``rounds`` rounds)."""
    mean = spread_rows(x, k, np.random.default_rng(seed))
    mix, old, n = Mixture(np.full(len(mean), 1 / len(mean)), mean, np.ones_like(mean)), -np.inf, 0
    while rounds is None or n < rounds:
        sums = mix.expect(x)
        if sums[-1] / len(x) - old < GAIN:
            break
        mix, old, n = mix.maximize(sums), sums[-1] / len(x), n + 1
    return mix


def name_components(mix: Mixture, examples: np.ndarray, kinds: list[str]) -> list[str]:
    """The kind of each component: that of the inspected example (standardized) next to its mean, by square roots of differences."""
    far = np.sqrt(np.abs(examples[None] - mix.mean[:, None])).sum(2)
    return [kinds[i] for i in far.argmin(1)]


def example_stats(lex: Lexicon) -> tuple[np.ndarray, list[str]]:
    """The statistics of the inspected examples, and their kinds."""
    own = [(kind, t) for kind, texts in EXAMPLES for t in texts]
    return batch_stats([t for _, t in own], lex)[1], [kind for kind, _ in own]


def fit_mixture(rows: DataFrame, id_col: str, lex: Lexicon) -> tuple[Mixture, np.ndarray, np.ndarray, list[str]] | None:
    """The mixture over all rows' statistics (column ``x``), what centres and scales them, and each component's kind.

    EM starts on at most START_ROWS rows and goes on over all rows until it converges. A round is one pass in which
    each task adds up its rows' responsibilities; only sums of the model's size reach the driver. None without rows.
    """
    d = len(MORE)

    def sums(fn, width):
        def run(batches):
            total = np.zeros(width)
            for b in batches:
                if b.num_rows:
                    total += fn(b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.float64))
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["s"])

        parts = rows.select("x").mapInArrow(run, "s array<double>").select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(width)
        for i, v in parts:
            out[i] = v
        return out

    first = sums(lambda x: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]), 1 + 2 * d)
    n = first[0]
    if not n:
        return None
    centre = first[1 : 1 + d] / n
    scale = np.sqrt(np.maximum(first[1 + d :] / n - centre**2, 1e-4))
    some = rows.orderBy(F.xxhash64(id_col), "x").limit(START_ROWS).select("x").toArrow().column(0)
    start = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in some.chunks]).reshape(-1, d)
    mix, old = start_mixture((start - centre) / scale), -np.inf
    while True:
        got = sums(lambda x, m=mix: m.expect((x - centre) / scale), len(mix.mean) * (1 + 2 * d) + 1)
        if got[-1] / n - old < GAIN:
            break
        mix, old = mix.maximize(got), got[-1] / n
    examples, kinds = example_stats(lex)
    return mix, centre, scale, name_components(mix, (examples - centre) / scale, kinds)


def _lexicon(common_words: DataFrame) -> frozenset[str]:
    return frozenset(str(r[0]).lower() for r in small_rows(common_words.select("token").filter("token is not null").distinct(), 100_000))


def text_stats(records: DataFrame, common_words: DataFrame, policies: DataFrame, id_col: str = "record_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, the statistics of BASIC, within_policy, x) for each text that is neither null nor blank.

    within_policy: the Han share is at least the source's min_cjk_ratio and the punctuation share at most
    its max_punctuation_ratio; null where the source has no policy. Repeated ids have a row each.
    """
    common = _lexicon(common_words)
    kind = records.schema[id_col].dataType.simpleString()
    shape = f"`{id_col}` {kind}, _source string, " + ", ".join(f"{c} double" for c in BASIC) + ", x array<float>"

    def run(batches):
        lex = Lexicon(common)
        for b in batches:
            texts = b.column(2).to_pylist()
            for i, j in blocks(texts, BATCH_CHARS):
                basic, more = batch_stats(texts[i:j], lex)
                x = pa.array(more.astype(np.float32).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) + 1, len(MORE), dtype=np.int32)), x)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), *(pa.array(basic[:, k]) for k in range(len(BASIC))), lists], names=[id_col, "_source", *BASIC, "x"])

    rows = records.select(F.col(id_col), plain_key(source_col).alias("_source"), F.col(text_col).alias("_text")).filter(F.regexp_like("_text", F.lit(r"[^\s\p{C}\p{Z}]")))
    got = rows.mapInArrow(run, shape)
    pol = policies.select(plain_key("source").alias("_source"), "min_cjk_ratio", "max_punctuation_ratio").groupBy("_source").agg(F.max("min_cjk_ratio").alias("_c"), F.min("max_punctuation_ratio").alias("_p"))
    ok = (F.col("han_share") >= F.col("_c")) & (F.col("punctuation_share") <= F.col("_p"))
    return got.join(pol, "_source", "left").select(id_col, *BASIC, ok.alias("within_policy"), "x")


def classify_texts(records: DataFrame, common_words: DataFrame, policies: DataFrame, id_col: str = "record_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, the statistics, within_policy, kind): kind is prose, list, table or junk for each text.

    Null and blank texts have no row. Texts of any length are read whole. The statistics are stored once and the
    mixture is fitted on all of them; a text has the kind of its likeliest component.
    """
    spark = records.sparkSession
    rows = materialize(text_stats(records, common_words, policies, id_col, text_col, source_col), "stats")
    names = [id_col, *BASIC, "within_policy"]
    shape = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names) + ", kind string"
    fitted = fit_mixture(rows, id_col, Lexicon(_lexicon(common_words)))
    if fitted is None:
        return spark.createDataFrame([], shape)
    shared = spark.sparkContext.broadcast(fitted)

    def run(batches):
        mix, centre, scale, kinds = shared.value
        named = np.array(kinds)
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(len(names)).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(MORE)).astype(np.float64)
            found = named[mix.density((x - centre) / scale).argmax(1)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(found.tolist(), pa.string())], names=[*names, "kind"])

    return rows.select(*names, "x").mapInArrow(run, shape)
