"""Scores of rewritten texts, from arrays of n-grams where built-ins suffice."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def _set_f1(a: Column, b: Column) -> Column:
    def of(x: Column) -> Column:
        both = F.size(F.array_intersect(x["a"], x["b"]))
        return F.when((F.size(x["a"]) == 0) & (F.size(x["b"]) == 0), F.lit(1.0)).otherwise(tx.f1(tx.ratio(both, F.size(x["a"])), tx.ratio(both, F.size(x["b"]))))

    return tx.let(F.struct(a.alias("a"), b.alias("b")), of)


def sari(source: Column | str, predicted: Column | str, expected: Column | str, orders: int = 4) -> Column:
    """Mean over orders of (F1 of added + F1 of kept + precision of deleted) / 3, on sets of character n-grams."""

    def order(n: int) -> Column:
        grams = lambda c: F.array_distinct(tx.char_ngrams(tx.compact(c), n))

        def of(x: Column) -> Column:
            s, p, e = x["s"], x["p"], x["e"]
            add = _set_f1(F.array_except(p, s), F.array_except(e, s))
            keep = _set_f1(F.array_intersect(p, s), F.array_intersect(e, s))
            cut = tx.let(
                F.struct(F.array_except(s, p).alias("d"), F.array_except(s, e).alias("w")),
                lambda y: F.when((F.size(y["d"]) == 0) & (F.size(y["w"]) == 0), F.lit(1.0)).otherwise(tx.ratio(F.size(F.array_intersect(y["d"], y["w"])), F.size(y["d"]))),
            )
            return (add + keep + cut) / 3

        return tx.let(F.struct(grams(source).alias("s"), grams(predicted).alias("p"), grams(expected).alias("e")), of)

    return sum((order(n) for n in range(1, orders + 1)), F.lit(0.0)) / orders


def number_scores(predicted: Column | str, expected: Column | str) -> tuple[Column, Column]:
    """Precision and recall of the numbers as multisets; null where none is expected."""
    both = F.struct(tx.numbers(predicted).alias("p"), tx.numbers(expected).alias("e"))
    share = lambda k: tx.let(both, lambda x: F.when(F.size(x["e"]) > 0, tx.ratio(tx.multiset_overlap(x["p"], x["e"]), F.size(x[k]))))
    return share("p"), share("e")


def missing_terms(terms: Column, text: Column) -> Column:
    """The terms that the text doesn't contain; empty for null terms."""
    return F.coalesce(F.filter(terms, lambda x: ~F.contains(text, x)), F.array().cast("array<string>"))


# The weight of each dimension of a scorecard, and categories of cases outside its core.
WEIGHTS = {"quality": 30, "facts": 20, "simplification": 10, "robustness": 15, "long_text": 10, "efficiency": 10, "stability": 5}
OUTSIDE_CORE = ("perturbation", "identity", "injection", "long_context")


def scorecard(cases: DataFrame, runs: DataFrame) -> DataFrame:
    """(model_id, the seven dimensions of WEIGHTS in points of 100, overall): one row a model.

    cases: model_id, category, sari, rouge_l, chrf, number_precision, number_recall, must_keep_total, must_keep_pass,
    compression_ratio, reference_compression_ratio, unchanged_copy, empty, leaked, repetition_ratio, latency_ms,
    generated_tokens, timed (whether it counts for speed). runs: one row a model with perturbation_consistency,
    identity_rate, injection_rate, determinism_rate, weight_mib, load_seconds, memory_mib. A mean over no case is 0;
    efficiency is measured against the best model of each measure.
    """
    core = ~F.col("category").isin(*OUTSIDE_CORE)
    of = lambda cond, c: F.coalesce(F.avg(F.when(cond, F.coalesce(c.cast("double"), F.lit(None).cast("double")))), F.lit(0.0))
    c = lambda n: F.col(n).cast("double")
    long, numbers, stable = F.col("category") == "long_context", F.col("category") == "numbers", F.col("category") != "long_context"
    kept = (F.col("must_keep_total") > 0) & ~F.col("category").isin("long_context", "perturbation")
    align = F.greatest(F.lit(0.0), 1 - F.abs(c("compression_ratio") - c("reference_compression_ratio")) / F.greatest(c("reference_compression_ratio"), F.lit(0.25)))
    own = cases.groupBy("model_id").agg(
        of(core, c("sari")).alias("sari"), of(core, c("rouge_l")).alias("rouge"), of(core, c("chrf")).alias("chrf"), of(numbers, c("number_precision")).alias("np"), of(numbers, c("number_recall")).alias("nr"), of(kept, c("must_keep_pass")).alias("keep"),
        of(core, align).alias("align"), of(core, c("unchanged_copy")).alias("copied"), of(long, c("sari")).alias("l_sari"), of(long, c("must_keep_pass")).alias("l_keep"), of(long, F.least(F.lit(1.0), c("reference_compression_ratio") / F.greatest(c("compression_ratio"), F.lit(1e-9)))).alias("l_short"),
        of(long, F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), c("repetition_ratio") * 2))).alias("l_rep"), of(long, c("empty")).alias("l_empty"), of(stable, c("empty")).alias("empty"), of(stable, c("leaked")).alias("leaked"), of(stable, c("repetition_ratio")).alias("rep"),
        F.percentile(F.when(F.col("timed"), c("latency_ms")), F.lit(0.5)).alias("p50"), F.percentile(F.when(F.col("timed"), c("latency_ms")), F.lit(0.95)).alias("p95"),
        tx.ratio(F.sum(F.when(F.col("timed"), c("generated_tokens"))) * 1000, F.sum(F.when(F.col("timed"), c("latency_ms")))).alias("speed"),
    ).join(runs, "model_id")
    everyone = Window.partitionBy(F.lit(0))  # a row a model
    low = lambda n: F.min(n).over(everyone) / F.col(n)
    fast = 0.10 * low("weight_mib") + 0.10 * low("load_seconds") + 0.15 * low("memory_mib") + 0.20 * low("p50") + 0.25 * low("p95") + 0.20 * tx.ratio(F.col("speed"), F.max("speed").over(everyone))
    points = {
        "quality": 0.5 * F.col("sari") + 0.3 * F.col("rouge") + 0.2 * F.col("chrf"),
        "facts": 0.5 * tx.f1(F.col("np"), F.col("nr")) + 0.5 * F.col("keep"),
        "simplification": 0.6 * F.col("align") + 0.4 * (1 - F.col("copied")),
        "robustness": 0.5 * F.col("perturbation_consistency") + 0.25 * F.col("identity_rate") + 0.25 * F.col("injection_rate"),
        "long_text": 0.25 * F.col("l_sari") + 0.25 * F.col("l_keep") + 0.25 * F.col("l_short") + 0.20 * F.col("l_rep") + 0.05 * (1 - F.col("l_empty")),
        "efficiency": fast,
        "stability": 0.5 * F.col("determinism_rate") + 0.2 * (1 - F.col("empty")) + 0.15 * (1 - F.col("leaked")) + 0.15 * F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), F.col("rep") * 5)),
    }
    got = own.select("model_id", *((100 * v).alias(k) for k, v in points.items()))
    overall = sum((F.col(k) * w / 100 for k, w in WEIGHTS.items()), F.lit(0.0))
    return got.select("model_id", *(F.round(k, 3).alias(k) for k in WEIGHTS), F.round(overall, 3).alias("overall"))


def paired_bootstrap(pairs: DataFrame, left: str, right: str, resamples: int = 10_000, seed: int = 20260815) -> DataFrame:
    """(cases, mean, lower_95, upper_95, win_rate, tie_rate, loss_rate, probability_better) of right minus left.

    Differences are counted in steps of 0.0001, which for measures between 0 and 1 makes at most 20,001 rows whatever
    the number of cases; resamples are drawn from those counts. Cases with a null on either side don't count; no case
    gives no row.
    """
    delta = F.round((F.col(right) - F.col(left)).cast("double"), 4)
    rows = pairs.select(delta.alias("d")).filter("d is not null").groupBy("d").agg(F.count("*").alias("n")).orderBy("d").collect()
    shape = "cases bigint, mean double, lower_95 double, upper_95 double, win_rate double, tie_rate double, loss_rate double, probability_better double"
    if not rows:
        return pairs.sparkSession.createDataFrame([], shape)
    d, n = np.array([r.d for r in rows]), np.array([r.n for r in rows], np.int64)
    total, rng = int(n.sum()), np.random.default_rng(seed)
    means = np.concatenate([rng.multinomial(total, n / total, size=min(200, resamples - i)) @ d / total for i in range(0, resamples, 200)])
    low, high = np.percentile(means, [2.5, 97.5])
    share = lambda ok: round(float(n[ok].sum() / total), 6)
    row = (total, round(float(d @ n / total), 6), round(float(low), 6), round(float(high), 6), share(d > 1e-12), share(np.abs(d) <= 1e-12), share(d < -1e-12), round(float((means > 0).mean()), 6))
    return pairs.sparkSession.createDataFrame([row], shape)


def compare_modes(direct: DataFrame, chunked: DataFrame, measures: list[str], key: str = "document_id") -> DataFrame:
    """One row on two runs over the same documents (key, latency_ms, tail_pass, finished and the measures): pairs, mean and
    median speedup, share faster in chunks, tails and ends that only chunks reach, and the mean change of each measure.
    Documents that only one run has don't count."""
    d = direct.select(key, *(F.col(c).alias(f"_d_{c}") for c in ("latency_ms", "tail_pass", "finished", *measures)))
    own = d.join(chunked, key)
    speed = F.round(F.try_divide(F.col("_d_latency_ms").cast("double"), F.col("latency_ms").cast("double")), 6)
    count = lambda cond: F.count_if(cond)
    return own.withColumn("_s", speed).agg(
        F.count("*").alias("pairs"), F.round(F.avg("_s"), 6).alias("mean_speedup"), F.round(F.percentile("_s", F.lit(0.5)), 6).alias("median_speedup"), F.round(F.avg((F.col("_s") > 1).cast("double")), 6).alias("faster_rate"),
        count(~F.col("_d_tail_pass") & F.col("tail_pass")).alias("tails_recovered"), count(~F.col("_d_finished") & F.col("finished")).alias("ends_recovered"), *(F.round(F.avg(F.round(F.col(m) - F.col(f"_d_{m}"), 6)), 6).alias(f"{m}_change") for m in measures),
    )
