"""Pairs of source and target: profiles, merges, audits, scores and their comparison; queries and SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import udfs
from ..operators import metrics, profiles, quality, ranking
from ..session import table

# Bins of source length, and groups of topic words.
LENGTHS = [("1-20", 1, 20), ("21-40", 21, 40), ("41-60", 41, 60), ("61-80", 61, 80), ("81-120", 81, 120), ("121-200", 121, 200), (">200", 201, float("inf"))]
EXTRA = [("1", 1, 1), ("2-3", 2, 3), ("4-5", 4, 5), ("6-10", 6, 10), ("11-20", 11, 20), (">20", 21, float("inf"))]
TOPICS = {
    "party_state": ["共产党", "中共中央", "政治局", "党委", "党组织", "毛泽东", "习近平", "邓小平", "社会主义", "共产主义", "马克思"],
    "government_law": ["国务院", "全国人大", "政府", "人民法院", "国家主席", "总理", "法律", "条例", "法院", "司法"],
    "foreign_sensitive": ["台湾", "香港", "澳门", "美国", "苏联", "外交", "殖民主义", "帝国主义"],
    "military": ["解放军", "军队", "全军", "国防", "军事"],
}


def newest_decisions(decisions: DataFrame) -> DataFrame:
    """One decision a pair: the newest by decided_at, then decision_id; null times are oldest."""
    names = [c for c in decisions.columns if c != "pair_id"]
    best = F.max_by(F.struct(*names), F.struct("decided_at", "decision_id"))
    return decisions.filter("pair_id is not null").groupBy("pair_id").agg(best.alias("_d")).select("pair_id", *(F.col(f"_d.{c}") for c in names))


def keyed_merge(pairs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Pairs with the target of their newest accepted decision in place of their own; ``changed`` says where."""
    new = newest_decisions(decisions).filter("accepted and candidate is not null").select("pair_id", F.col("candidate").alias("_c"))
    own = pairs.join(new, "pair_id", "left")
    return own.withColumn("changed", F.col("_c").isNotNull() & ~F.col("_c").eqNullSafe(F.col("target"))).withColumn("target", F.coalesce("_c", "target")).drop("_c")


def pair_issues(pairs: DataFrame, decisions: DataFrame) -> DataFrame:
    """(pair_id, code): what is wrong with decisions and pairs, one row an issue.

    missing_decision: a pair without one; withdrawn_pair: a decision without its pair; accepted_with_reasons;
    empty_candidate; number_mismatch (accepted, numbers differ as multisets); changed_while_rejected.
    """
    new = newest_decisions(decisions).select("pair_id", "accepted", "candidate", "reasons", F.lit(True).alias("_has"))
    own = pairs.select("pair_id", "source", "target", F.lit(True).alias("_pair")).join(new, "pair_id", "full_outer")
    when = lambda c, name: F.when(c, F.lit(name))
    ok = F.col("_pair").isNotNull() & F.col("_has").isNotNull()
    found = F.array(
        when(F.col("_has").isNull(), "missing_decision"),
        when(F.col("_pair").isNull(), "withdrawn_pair"),
        when(ok & F.col("accepted") & (F.size(F.coalesce("reasons", F.array().cast("array<string>"))) > 0), "accepted_with_reasons"),
        when(ok & (tx.strip(F.coalesce("candidate", F.lit(""))) == ""), "empty_candidate"),
        when(ok & F.col("accepted") & ~tx.same_multiset(tx.numbers("source", tx.NUMBER_SPAN), tx.numbers("candidate", tx.NUMBER_SPAN)), "number_mismatch"),
        when(ok & ~F.col("accepted") & ~F.col("candidate").eqNullSafe(F.col("target")), "changed_while_rejected"),
    )
    return own.select("pair_id", F.explode(F.array_compact(found)).alias("code"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "pair_records").filter("source is not null and target is not null and length(source) > 0")
    return own.withColumn("split", F.lower(F.trim("split")))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Pairs whose newest decision has a candidate, which is scored against the pair's target."""
    new = newest_decisions(table(spark, d, "quality_decisions")).select("pair_id", "candidate", "accepted").filter("candidate is not null")
    return _pairs(spark, d).join(new, "pair_id")


def pair_statistics(spark, d):
    own = _pairs(spark, d)
    by = own.groupBy("split", F.md5("source").alias("s")).agg(F.count_distinct("target").alias("k"), F.count("*").alias("n"), F.count_if(F.col("source") == F.col("target")).alias("same"), F.count_if(F.length("target") > F.length("source")).alias("longer"))
    return by.groupBy("split").agg(F.sum("n").alias("rows"), F.count("*").alias("unique_sources"), F.count_if(F.col("k") > 1).alias("sources_with_multiple_targets"), F.sum("same").alias("unchanged_pairs"), F.sum("longer").alias("target_longer_than_source"))


def length_percentiles(spark, d):
    """Source lengths by split under three rules: place floor(n q), place round((n - 1) q), and between values."""
    own = _pairs(spark, d).select("split", F.length("source").alias("v"))
    q = {"p50": 0.5, "p90": 0.9, "p95": 0.95}
    cast = lambda df, rule: df.select("split", F.lit(rule).alias("rule"), *(F.col(k).cast("double").alias(k) for k in q))
    return cast(profiles.rank_percentiles(own, ["split"], "v", q, "floor"), "floor").unionByName(cast(profiles.rank_percentiles(own, ["split"], "v", q, "round"), "round")).unionByName(cast(profiles.linear_percentiles(own, ["split"], "v", q), "linear"))


def length_relations(spark, d):
    """Shorter, equal and longer targets by split and over all."""
    s, t = F.length(tx.compact("source")), F.length(tx.compact("target"))
    own = _pairs(spark, d).select("split", s.alias("s"), t.alias("t"))
    agg = (F.count("*").alias("rows"), F.count_if(F.expr("t < s")).alias("shorter"), F.count_if(F.expr("t = s")).alias("equal"), F.count_if(F.expr("t > s")).alias("longer"), F.sum("s").alias("source_chars"), F.sum("t").alias("target_chars"))
    return own.rollup("split").agg(*agg).select(F.coalesce("split", F.lit("all")).alias("split"), "rows", "shorter", "equal", "longer", "source_chars", "target_chars")


def length_bins(spark, d):
    s, t = F.length(tx.compact("source")), F.length(tx.compact("target"))
    own = _pairs(spark, d).select(profiles.bins(s, LENGTHS).alias("bin"), (t - s).alias("more"))
    return own.groupBy("bin").agg(F.count("*").alias("rows"), *(F.count_if(F.col("more").between(a, b)).alias("extra_" + k.replace("-", "_").replace(">", "over_")) for k, a, b in EXTRA))


def topic_rates(pairs: DataFrame, topics: dict[str, list[str]] = TOPICS) -> DataFrame:
    """(topic, matched, unmatched, their unchanged pairs and shares, risk_ratio): how often sources with a topic's words
    are left unchanged, and the others; ``any`` is all topics together. A ratio is null where the others never are."""
    own = pairs.select((F.col("source") == F.col("target")).alias("same"), *(F.regexp_like("source", F.lit("|".join(ws))).alias(g) for g, ws in topics.items()))
    own = own.groupBy("same", *topics).agg(F.count("*").alias("n"))  # a row for each combination of topics
    hit = F.lit(False)
    for g in topics:
        hit = hit | F.col(g)
    rows = own.withColumn("any", hit).select("same", "n", F.explode(F.array(*(F.struct(F.lit(g).alias("topic"), F.col(g).alias("hit")) for g in [*topics, "any"]))).alias("t"))
    many = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    agg = rows.groupBy("t.topic").agg(many(F.col("t.hit")).alias("matched"), many(~F.col("t.hit")).alias("unmatched"), many(F.col("t.hit") & F.col("same")).alias("matched_same"), many(~F.col("t.hit") & F.col("same")).alias("unmatched_same"))
    a, b = tx.ratio(F.col("matched_same"), F.col("matched")), tx.ratio(F.col("unmatched_same"), F.col("unmatched"))
    return agg.select("topic", "matched", "unmatched", "matched_same", "unmatched_same", F.round(a, 6).alias("matched_rate"), F.round(b, 6).alias("unmatched_rate"), F.round(F.try_divide(a, b), 6).alias("risk_ratio"))


def topic_risk(spark, d):
    return topic_rates(_pairs(spark, d))


def newest_decision_reasons(spark, d):
    own = newest_decisions(table(spark, d, "quality_decisions"))
    return own.select("accepted", F.explode_outer("reasons").alias("reason")).groupBy("accepted", "reason").agg(F.count("*").alias("decisions"))


def merged_targets(spark, d):
    own = keyed_merge(table(spark, d, "pair_records"), table(spark, d, "quality_decisions"))
    return own.groupBy(F.lower(F.trim("split")).alias("split")).agg(F.count("*").alias("rows"), F.count_if("changed").alias("changed"), F.sum(F.length("target")).alias("target_chars"))


def pair_issue_report(spark, d):
    return pair_issues(table(spark, d, "pair_records"), table(spark, d, "quality_decisions")).groupBy("code").agg(F.count("*").alias("issues"))


def candidate_decisions(spark, d):
    """All eleven reasons found again in each pair and its newest candidate, counted. Compatibility forms are folded; a
    candidate that isn't there is empty."""
    new = newest_decisions(table(spark, d, "quality_decisions")).select("pair_id", "candidate", "truncated")
    own = _pairs(spark, d).join(new, "pair_id").withColumns({"s": udfs.nfkc("source"), "c": udfs.nfkc(F.coalesce("candidate", F.lit("")))})
    a, b = tx.surface("s"), tx.surface("c")
    alike = F.when((a == "") | (b == ""), 0.0).otherwise(udfs.sequence_ratio(a, b))
    own = own.select("pair_id", quality.candidate_reasons("s", "c", "truncated", alike).alias("r"))
    return own.select(F.explode_outer("r").alias("reason")).groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("pairs"))


def removed_line_rerank(spark, d):
    """Line numbers of each split after pairs with a target over 1.5 times the source are taken out."""
    own = _pairs(spark, d).filter("line_number is not null").filter(F.length("target") <= 1.5 * F.length("source"))
    kept = own.groupBy("split", "line_number").agg(F.min("pair_id").alias("pair_id"))
    parts = [ranking.global_rank(kept.filter(F.col("split") == s), ["line_number"]).select("split", "pair_id", (F.col("rank") + 1).alias("line")) for s in ("train", "validation", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def identity_rows(spark, d):
    own = _pairs(spark, d).filter("source = target")
    return own.select("pair_id", F.concat_ws(":", "split", F.col("line_number").cast("string")).alias("key"))


def pair_ngram_jaccard(spark, d):
    g = lambda c: F.array_distinct(tx.char_ngrams(tx.dedupe_form(c), 4))
    return _pairs(spark, d).select("pair_id", F.round(tx.jaccard(g("source"), g("target")), 6).alias("jaccard"))


def sari_scores(spark, d):
    return _scored(spark, d).select("pair_id", F.round(metrics.sari("source", "candidate", "target"), 6).alias("sari"))


def number_scores(spark, d):
    p, r = metrics.number_scores("candidate", "target")
    return _scored(spark, d).select("pair_id", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"))


def alignment_scores(spark, d):
    """ROUGE-L and chrF by split."""
    own = _scored(spark, d).select("split", udfs.rouge_l("candidate", "target").alias("rouge_l"), udfs.chrf("candidate", "target").alias("chrf"))
    return own.groupBy("split").agg(F.count("*").alias("pairs"), F.round(F.avg("rouge_l"), 6).alias("rouge_l"), F.round(F.avg("chrf"), 6).alias("chrf"))


def surface_similarity(spark, d):
    """Similarity of surfaces as the decisions hold it, beside the value found again."""
    own = newest_decisions(table(spark, d, "quality_decisions")).select("pair_id", "candidate", "similarity").join(_pairs(spark, d), "pair_id")
    own = own.select("similarity", udfs.sequence_ratio(tx.surface(udfs.nfkc("source")), tx.surface(udfs.nfkc("candidate"))).alias("again"))
    return own.agg(F.count("*").alias("pairs"), F.round(F.avg(F.abs(F.col("similarity") - F.col("again"))), 4).alias("mean_gap"))


def paired_outcomes(spark, d):
    """The candidate against the bare source, judged by SARI: wins, ties, losses and the mean gap."""
    own = _scored(spark, d).select("split", F.round(metrics.sari("source", "candidate", "target") - metrics.sari("source", "source", "target"), 9).alias("gap"))
    return own.groupBy("split").agg(F.count_if(F.expr("gap > 1e-12")).alias("wins"), F.count_if(F.expr("abs(gap) <= 1e-12")).alias("ties"), F.count_if(F.expr("gap < -1e-12")).alias("losses"), F.round(F.avg("gap"), 6).alias("mean_gap"))


def wilson_by_origin(spark, d):
    new = newest_decisions(table(spark, d, "quality_decisions")).select("pair_id", "accepted")
    own = _pairs(spark, d).join(new, "pair_id").groupBy(F.coalesce("origin", F.lit("unknown")).alias("origin")).agg(F.count("*").alias("n"), F.count_if("accepted").alias("accepted"))
    low, high = profiles.wilson(F.col("accepted"), F.col("n"))
    return own.select("origin", "n", "accepted", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def calibration(spark, d):
    """Similarity as a confidence in being accepted, over ten bins."""
    own = newest_decisions(table(spark, d, "quality_decisions")).filter("similarity is not null and accepted is not null")
    return profiles.calibration_error(own, "similarity", "accepted")


def bootstrap_mean(df: DataFrame, key: str, value: str, rounds: int = 2000, seed: int = 17) -> DataFrame:
    """(key, n, mean, low, high): percentile interval of the mean under resampling.

    Values are counted first; each round draws how often each value occurs (a Poisson count for its rows), so
    rounds are sums over counted values and no group meets in one task.
    """
    counts = profiles.value_counts(df, [key], value)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            k, v, c = (b.column(i).to_pandas() for i in range(3))
            for g, at in k.groupby(k, dropna=False).groups.items():
                vv, cc = v.loc[at].to_numpy(float), c.loc[at].to_numpy(float)
                draws = np.stack([np.random.default_rng([seed, abs(hash((round(float(x), 12), int(n)))) % (1 << 32)]).poisson(n, rounds) for x, n in zip(vv, cc)])
                yield pd.DataFrame({"k": g, "i": np.arange(rounds), "s": draws.T @ vv, "n": draws.sum(0).astype(float)})

    def arrow(batches):
        import pyarrow as pa

        for f in run(batches):
            yield pa.RecordBatch.from_pandas(f, preserve_index=False)

    drawn = counts.select(F.col(key).cast("string"), F.col("v").cast("double"), "c").mapInArrow(arrow, "k string, i bigint, s double, n double")
    means = drawn.groupBy("k", "i").agg((F.sum("s") / F.sum("n")).alias("m"))
    bounds = means.groupBy("k").agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    own = counts.groupBy(F.col(key).cast("string").alias("k")).agg(F.sum("c").alias("n"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"))
    return own.join(bounds, "k").select(F.col("k").alias(key), "n", F.round("mean", 6).alias("mean"), F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


def bootstrap_ci(spark, d):
    own = _scored(spark, d).select("split", F.round(tx.ratio(F.length("candidate"), F.length("source")), 2).alias("ratio"))
    return bootstrap_mean(own, "split", "ratio")


def scorecard(spark, d):
    """Seven dimensions and their weighted sum for two runs over the same made-up cases."""
    n = F.col("id")
    kinds = F.array(*map(F.lit, ("plain", "numbers", "long_context", "perturbation", "identity", "news")))
    part = lambda k, p: ((n * k + F.length("model_id") * 13) % p) / p
    cases = spark.range(1200).withColumn("model_id", F.explode(F.array(F.lit("base"), F.lit("tuned")))).select(
        "model_id", F.get(kinds, (n % 6).cast("int")).alias("category"), part(7, 101).alias("sari"), part(11, 103).alias("rouge_l"), part(13, 107).alias("chrf"), F.when(n % 4 > 0, part(17, 109)).alias("number_precision"), part(19, 113).alias("number_recall"), (n % 3).alias("must_keep_total"),
        (n % 5 > 0).alias("must_keep_pass"), (part(23, 127) + 0.1).alias("compression_ratio"), (part(29, 131) + 0.05).alias("reference_compression_ratio"), (n % 17 == 0).alias("unchanged_copy"), (n % 41 == 0).alias("empty"), (n % 43 == 0).alias("leaked"), (part(31, 137) / 4).alias("repetition_ratio"),
        (part(37, 139) * 900 + 100).alias("latency_ms"), (n % 50 + 1).alias("generated_tokens"), (n % 2 == 0).alias("timed"),
    )
    runs = spark.createDataFrame([("base", 0.8, 0.9, 0.7, 1.0, 120.0, 2.0, 900.0), ("tuned", 0.7, 1.0, 0.6, 0.95, 100.0, 3.0, 800.0)], "model_id string, perturbation_consistency double, identity_rate double, injection_rate double, determinism_rate double, weight_mib double, load_seconds double, memory_mib double")
    return metrics.scorecard(cases, runs)


def mode_comparison(spark, d):
    """Sources as one run, targets as another: lengths as latency, numbers kept as a measure."""
    own = _pairs(spark, d)
    run = lambda c, k: own.select(F.col("pair_id").alias("document_id"), (F.length(c) * k).alias("latency_ms"), F.endswith(c, F.lit("。")).alias("tail_pass"), (F.length(c) > 40).alias("finished"), F.size(tx.numbers(c)).cast("double").alias("numbers"))
    return metrics.compare_modes(run("source", 2).filter("document_id % 3 > 0"), run("target", 3), ["numbers"])


def paired_difference(spark, d):
    """Number F1 of candidates against that of targets, resampled."""
    own = _scored(spark, d).select(*(tx.f1(*metrics.number_scores(c, "source")).alias(a) for c, a in (("target", "l"), ("candidate", "r"))))
    return metrics.paired_bootstrap(own, "l", "r")


def must_keep_terms(spark, d):
    """Terms that a long document's target must keep, and how many are missing."""
    own = table(spark, d, "long_documents").filter("target is not null").select("category", "must_keep", "tail_keep", metrics.missing_terms(F.col("must_keep"), F.col("target")).alias("m"), metrics.missing_terms(F.col("tail_keep"), F.col("target")).alias("t"))
    return own.groupBy("category").agg(F.count("*").alias("documents"), F.sum(F.coalesce(F.size("must_keep"), F.lit(0))).alias("terms"), F.sum(F.size("m")).alias("missing"), F.count_if(F.size("t") == 0).alias("tails_kept"))


_P = "WITH p AS (SELECT * REPLACE (lower(trim(split)) AS split) FROM pair_records WHERE source IS NOT NULL AND target IS NOT NULL AND length(source) > 0)"
_N = "n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY decided_at DESC NULLS LAST, decision_id DESC) AS rn FROM quality_decisions WHERE pair_id IS NOT NULL) WHERE rn = 1)"
_S = f"{_P}, {_N}, s AS (SELECT p.*, n.candidate, n.accepted FROM p JOIN n USING (pair_id) WHERE candidate IS NOT NULL)"
_CMP = lambda c: f"length(regexp_replace({c}, '[\\s\\p{{Z}}\\x{{1c}}-\\x{{1f}}\\x{{85}}]+', '', 'g'))"
_TXT = lambda c: f"regexp_replace({c}, '[\\s\\p{{Z}}\\x{{1c}}-\\x{{1f}}\\x{{85}}]+', '', 'g')"
_GR = lambda c, n: f"CASE WHEN length({c}) >= {n} THEN list_distinct(list_transform(generate_series(1, length({c}) - {n - 1}), lambda i: substr({c}, i, {n}))) ELSE [] END"
_NUM = lambda c: f"regexp_extract_all({c}, '\\p{{Nd}}+(?:\\.\\p{{Nd}}+)?%?')"
_NSP = lambda c: f"regexp_extract_all({c}, '\\p{{Nd}}+(?:[.:：/\\-—]\\p{{Nd}}+)*%?')"
_MULTI = "list_sum(list_transform(list_distinct({0}), lambda x: least(len(list_filter({0}, lambda y: y = x)), len(list_filter({1}, lambda y: y = x)))))"
_LCASE = " ".join(f"WHEN s BETWEEN {a} AND {b if b != float('inf') else 10**9} THEN '{k}'" for k, a, b in LENGTHS)


def _f1_sql(a: str, b: str) -> str:
    n = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 ELSE coalesce(2.0 * {n} / nullif(len({a}) + len({b}), 0), 0) END"


def _sari_sql(s: str, p: str, e: str) -> str:
    parts = []
    for n in range(1, 5):
        a, b, c = f"{s}{n}", f"{p}{n}", f"{e}{n}"
        ex = lambda x, y: f"list_filter({x}, lambda z: NOT list_contains({y}, z))"
        add = _f1_sql(ex(b, a), ex(c, a))
        keep = _f1_sql(f"list_intersect({b}, {a})", f"list_intersect({c}, {a})")
        gone, want = ex(a, b), ex(a, c)
        cut = f"CASE WHEN len({gone}) = 0 AND len({want}) = 0 THEN 1.0 ELSE coalesce(len(list_intersect({gone}, {want})) / nullif(len({gone}), 0), 0) END"
        parts.append(f"({add} + {keep} + {cut}) / 3")
    return "(" + " + ".join(parts) + ") / 4"


_GRAMS = ", ".join(f"{_GR(c, n)} AS {a}{n}" for a, c in (("s", "cs"), ("p", "cp"), ("e", "ce")) for n in range(1, 5))
_SG = f"{_S}, c AS (SELECT pair_id, split, {_TXT('source')} AS cs, {_TXT('candidate')} AS cp, {_TXT('target')} AS ce FROM s), g AS (SELECT pair_id, split, {_GRAMS} FROM c)"

SQL = {
    "pair_statistics": f"{_P}, b AS (SELECT split, source, count(DISTINCT target) AS k, count(*) AS n, count(*) FILTER (WHERE source = target) AS same, count(*) FILTER (WHERE length(target) > length(source)) AS longer FROM p GROUP BY 1, 2) SELECT split, sum(n) AS rows, count(*) AS unique_sources, count(*) FILTER (WHERE k > 1) AS sources_with_multiple_targets, sum(same) AS unchanged_pairs, sum(longer) AS target_longer_than_source FROM b GROUP BY 1",
    "length_percentiles": f"{_P}, r AS (SELECT split, length(source) AS v, row_number() OVER (PARTITION BY split ORDER BY length(source)) - 1 AS r, count(*) OVER (PARTITION BY split) AS n FROM p) "
    + " UNION ALL ".join([f"SELECT split, '{rule}' AS rule, " + ", ".join(f"max(CASE WHEN r = {at.format(q)} THEN v END)::DOUBLE AS {k}" for k, q in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95))) + " FROM r GROUP BY split" for rule, at in (("floor", "least(n - 1, floor(n * {0}))"), ("round", "round_even((n - 1) * {0}::DOUBLE, 0)"))] + ["SELECT split, 'linear' AS rule, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.9), 6) AS p90, round(quantile_cont(v, 0.95), 6) AS p95 FROM r GROUP BY split"]),
    "length_relations": f"{_P}, o AS (SELECT split, {_CMP('source')} AS s, {_CMP('target')} AS t FROM p) SELECT coalesce(split, 'all') AS split, count(*) AS rows, count(*) FILTER (WHERE t < s) AS shorter, count(*) FILTER (WHERE t = s) AS equal, count(*) FILTER (WHERE t > s) AS longer, sum(s) AS source_chars, sum(t) AS target_chars FROM o GROUP BY GROUPING SETS ((split), ())",
    "length_bins": f"{_P}, o AS (SELECT {_CMP('source')} AS s, {_CMP('target')} - {_CMP('source')} AS more FROM p) SELECT CASE {_LCASE} END AS bin, count(*) AS rows, " + ", ".join(f"count(*) FILTER (WHERE more BETWEEN {a} AND {b if b != float('inf') else 10**9}) AS extra_{k.replace('-', '_').replace('>', 'over_')}" for k, a, b in EXTRA) + " FROM o GROUP BY 1",
    "topic_risk": f"""{_P}, t AS (SELECT source = target AS same, regexp_matches(source, '共产党|中共中央|政治局|党委|党组织|毛泽东|习近平|邓小平|社会主义|共产主义|马克思') AS a, regexp_matches(source, '国务院|全国人大|政府|人民法院|国家主席|总理|法律|条例|法院|司法') AS b,
            regexp_matches(source, '台湾|香港|澳门|美国|苏联|外交|殖民主义|帝国主义') AS c, regexp_matches(source, '解放军|军队|全军|国防|军事') AS d FROM p),
        u AS (SELECT same, unnest([{{'k': 'party_state', 'h': a}}, {{'k': 'government_law', 'h': b}}, {{'k': 'foreign_sensitive', 'h': c}}, {{'k': 'military', 'h': d}}, {{'k': 'any', 'h': a OR b OR c OR d}}]) AS x FROM t),
        g AS (SELECT x.k AS topic, count(*) FILTER (WHERE x.h) AS matched, count(*) FILTER (WHERE NOT x.h) AS unmatched, count(*) FILTER (WHERE x.h AND same) AS matched_same, count(*) FILTER (WHERE NOT x.h AND same) AS unmatched_same FROM u GROUP BY 1)
        SELECT *, round(coalesce(matched_same / nullif(matched, 0), 0), 6) AS matched_rate, round(coalesce(unmatched_same / nullif(unmatched, 0), 0), 6) AS unmatched_rate,
            round(coalesce(matched_same / nullif(matched, 0), 0) / nullif(coalesce(unmatched_same / nullif(unmatched, 0), 0), 0), 6) AS risk_ratio FROM g""",
    "newest_decision_reasons": f"WITH {_N}, e AS (SELECT accepted, CASE WHEN reasons IS NULL OR len(reasons) = 0 THEN [NULL] ELSE reasons END AS r FROM n) SELECT accepted, reason, count(*) AS decisions FROM (SELECT accepted, unnest(r) AS reason FROM e) GROUP BY 1, 2",
    "merged_targets": f"WITH {_N}, a AS (SELECT pair_id, candidate FROM n WHERE accepted AND candidate IS NOT NULL) SELECT lower(trim(split)) AS split, count(*) AS rows, count(*) FILTER (WHERE candidate IS NOT NULL AND candidate IS DISTINCT FROM target) AS changed, sum(length(coalesce(candidate, target))) AS target_chars FROM pair_records LEFT JOIN a USING (pair_id) GROUP BY 1",
    "pair_issue_report": f"WITH {_N}, o AS (SELECT coalesce(p.pair_id, n.pair_id) AS id, p.pair_id AS a, n.pair_id AS b, p.source, p.target, n.accepted, n.candidate, n.reasons FROM pair_records p FULL OUTER JOIN n ON p.pair_id = n.pair_id), i AS (SELECT 'missing_decision' AS code FROM o WHERE b IS NULL UNION ALL SELECT 'withdrawn_pair' FROM o WHERE a IS NULL UNION ALL SELECT 'accepted_with_reasons' FROM o WHERE a IS NOT NULL AND b IS NOT NULL AND accepted AND len(coalesce(reasons, [])) > 0 UNION ALL SELECT 'empty_candidate' FROM o WHERE a IS NOT NULL AND b IS NOT NULL AND regexp_replace(coalesce(candidate, ''), '[\\s\\p{{Z}}]', '', 'g') = '' UNION ALL SELECT 'number_mismatch' FROM o WHERE a IS NOT NULL AND b IS NOT NULL AND accepted AND list_sort({_NSP('source')}) <> list_sort({_NSP('candidate')}) UNION ALL SELECT 'changed_while_rejected' FROM o WHERE a IS NOT NULL AND b IS NOT NULL AND NOT accepted AND candidate IS DISTINCT FROM target) SELECT code, count(*) AS issues FROM i GROUP BY 1",
    "removed_line_rerank": f"{_P}, k AS (SELECT split, line_number, min(pair_id) AS pair_id FROM p WHERE line_number IS NOT NULL AND length(target) <= 1.5 * length(source) GROUP BY 1, 2) SELECT split, pair_id, row_number() OVER (PARTITION BY split ORDER BY line_number) AS line FROM k",
    "identity_rows": f"{_P} SELECT pair_id, split || ':' || line_number AS key FROM p WHERE source = target",
    "pair_ngram_jaccard": f"{_P}, f AS (SELECT pair_id, lower(regexp_replace(source, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) AS a, lower(regexp_replace(target, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) AS b FROM p), g AS (SELECT pair_id, {_GR('a', 4)} AS a, {_GR('b', 4)} AS b FROM f) SELECT pair_id, round(coalesce(len(list_intersect(a, b)) / nullif(len(a) + len(b) - len(list_intersect(a, b)), 0), 0), 6) AS jaccard FROM g",
    "sari_scores": f"{_SG} SELECT pair_id, round({_sari_sql('s', 'p', 'e')}, 6) AS sari FROM g",
    "paired_outcomes": f"{_SG}, x AS (SELECT split, round({_sari_sql('s', 'p', 'e')} - {_sari_sql('s', 's', 'e')}, 9) AS gap FROM g) SELECT split, count(*) FILTER (WHERE gap > 1e-12) AS wins, count(*) FILTER (WHERE abs(gap) <= 1e-12) AS ties, count(*) FILTER (WHERE gap < -1e-12) AS losses, round(avg(gap), 6) AS mean_gap FROM x GROUP BY 1",
    "number_scores": f"{_S}, k AS (SELECT pair_id, {_NUM('candidate')} AS p, {_NUM('target')} AS e FROM s) SELECT pair_id, CASE WHEN len(e) > 0 THEN round(coalesce(coalesce({_MULTI.format('p', 'e')}, 0) / nullif(len(p), 0), 0), 6) END AS precision, CASE WHEN len(e) > 0 THEN round(coalesce({_MULTI.format('p', 'e')}, 0) / len(e), 6) END AS recall FROM k",
    "wilson_by_origin": f"{_P}, {_N}, a AS (SELECT coalesce(origin, 'unknown') AS origin, count(*) AS n, count(*) FILTER (WHERE accepted) AS accepted FROM p JOIN n USING (pair_id) GROUP BY 1), w AS (SELECT *, accepted / n AS q, 1.959963984540054::DOUBLE AS z FROM a) SELECT origin, n, accepted, round(greatest(0, (q + z * z / (2 * n) - z * sqrt(q * (1 - q) / n + z * z / (4.0 * n * n))) / (1 + z * z / n)), 6) AS low, round(least(1, (q + z * z / (2 * n) + z * sqrt(q * (1 - q) / n + z * z / (4.0 * n * n))) / (1 + z * z / n)), 6) AS high FROM w",
    "calibration": f"WITH {_N}, o AS (SELECT similarity AS c, accepted::INT AS a, count(*) OVER () AS n FROM n WHERE similarity IS NOT NULL AND accepted IS NOT NULL), b AS (SELECT least(floor(c * 10), 9) AS b, count(*) AS k, avg(a) AS acc, avg(c) AS conf, max(n) AS n FROM o WHERE c BETWEEN 0 AND 1 GROUP BY 1) SELECT round(coalesce(sum(k / n * abs(acc - conf)), 0), 9) AS ece FROM b",
    "scorecard": """
        WITH k AS (SELECT range AS n, m.m, ['plain', 'numbers', 'long_context', 'perturbation', 'identity', 'news'][range % 6 + 1] AS category, length(m.m) * 13 AS z FROM range(1200), (VALUES ('base'), ('tuned')) m(m)),
        c AS (SELECT *, (n * 7 + z) % 101 / 101 AS sari, (n * 11 + z) % 103 / 103 AS rouge, (n * 13 + z) % 107 / 107 AS chrf, CASE WHEN n % 4 > 0 THEN (n * 17 + z) % 109 / 109 END AS np, (n * 19 + z) % 113 / 113 AS nr, (n % 5 > 0)::INT AS keep, (n * 23 + z) % 127 / 127 + 0.1::DOUBLE AS cr, (n * 29 + z) % 131 / 131 + 0.05::DOUBLE AS rc,
                (n * 31 + z) % 137 / 137 / 4 AS rep, (n * 37 + z) % 139 / 139 * 900 + 100 AS ms, category NOT IN ('perturbation', 'identity', 'injection', 'long_context') AS core, category = 'long_context' AS lng FROM k),
        g AS (SELECT m, avg(sari) FILTER (WHERE core) AS sari, avg(rouge) FILTER (WHERE core) AS rouge, avg(chrf) FILTER (WHERE core) AS chrf, avg(np) FILTER (WHERE category = 'numbers') AS np, avg(nr) FILTER (WHERE category = 'numbers') AS nr, avg(keep) FILTER (WHERE n % 3 > 0 AND category NOT IN ('long_context', 'perturbation')) AS keep,
                avg(greatest(0, 1 - abs(cr - rc) / greatest(rc, 0.25::DOUBLE))) FILTER (WHERE core) AS align, avg((n % 17 = 0)::INT) FILTER (WHERE core) AS copied, coalesce(avg(sari) FILTER (WHERE lng), 0) AS ls, coalesce(avg(keep) FILTER (WHERE lng), 0) AS lk, coalesce(avg(least(1, rc / greatest(cr, 1e-9::DOUBLE))) FILTER (WHERE lng), 0) AS lc,
                coalesce(avg(greatest(0, 1 - least(1, rep * 2))) FILTER (WHERE lng), 0) AS lr, coalesce(avg((n % 41 = 0)::INT) FILTER (WHERE lng), 0) AS le, avg((n % 41 = 0)::INT) FILTER (WHERE NOT lng) AS em, avg((n % 43 = 0)::INT) FILTER (WHERE NOT lng) AS lk2, avg(rep) FILTER (WHERE NOT lng) AS rep,
                quantile_cont(ms, 0.5) FILTER (WHERE n % 2 = 0) AS p50, quantile_cont(ms, 0.95) FILTER (WHERE n % 2 = 0) AS p95, sum(n % 50 + 1) FILTER (WHERE n % 2 = 0) * 1000 / sum(ms) FILTER (WHERE n % 2 = 0) AS speed FROM c GROUP BY m),
        r AS (SELECT * FROM g JOIN (VALUES ('base', 0.8::DOUBLE, 0.9::DOUBLE, 0.7::DOUBLE, 1.0::DOUBLE, 120.0::DOUBLE, 2.0::DOUBLE, 900.0::DOUBLE), ('tuned', 0.7, 1.0, 0.6, 0.95, 100.0, 3.0, 800.0)) v(m, pc, ir, jr, dt, wt, ld, mm) USING (m)),
        s AS (SELECT m AS model_id, 100 * (0.5::DOUBLE * sari + 0.3::DOUBLE * rouge + 0.2::DOUBLE * chrf) AS quality, 100 * (0.5::DOUBLE * (2 * np * nr / (np + nr)) + 0.5::DOUBLE * keep) AS facts, 100 * (0.6::DOUBLE * align + 0.4::DOUBLE * (1 - copied)) AS simplification, 100 * (0.5::DOUBLE * pc + 0.25::DOUBLE * ir + 0.25::DOUBLE * jr) AS robustness,
                100 * (0.25::DOUBLE * ls + 0.25::DOUBLE * lk + 0.25::DOUBLE * lc + 0.2::DOUBLE * lr + 0.05::DOUBLE * (1 - le)) AS long_text,
                100 * (0.1::DOUBLE * min(wt) OVER () / wt + 0.1::DOUBLE * min(ld) OVER () / ld + 0.15::DOUBLE * min(mm) OVER () / mm + 0.2::DOUBLE * min(p50) OVER () / p50 + 0.25::DOUBLE * min(p95) OVER () / p95 + 0.2::DOUBLE * speed / max(speed) OVER ()) AS efficiency,
                100 * (0.5::DOUBLE * dt + 0.2::DOUBLE * (1 - em) + 0.15::DOUBLE * (1 - lk2) + 0.15::DOUBLE * greatest(0, 1 - least(1, rep * 5))) AS stability FROM r)
        SELECT model_id, round(quality, 3) AS quality, round(facts, 3) AS facts, round(simplification, 3) AS simplification, round(robustness, 3) AS robustness, round(long_text, 3) AS long_text, round(efficiency, 3) AS efficiency, round(stability, 3) AS stability,
            round((quality * 30 + facts * 20 + simplification * 10 + robustness * 15 + long_text * 10 + efficiency * 10 + stability * 5) / 100, 3) AS overall FROM s""",
    "mode_comparison": f"""{_P}, m AS (SELECT round(length(source) * 2.0::DOUBLE / nullif(length(target) * 3, 0), 6) AS s, NOT ends_with(source, '。') AND ends_with(target, '。') AS t, length(source) <= 40 AND length(target) > 40 AS e, len(regexp_extract_all(target, '\\p{{Nd}}+(?:\\.\\p{{Nd}}+)?%?')) - len(regexp_extract_all(source, '\\p{{Nd}}+(?:\\.\\p{{Nd}}+)?%?')) AS n FROM p WHERE pair_id % 3 > 0)
        SELECT count(*) AS pairs, round(avg(s), 6) AS mean_speedup, round(quantile_cont(s, 0.5), 6) AS median_speedup, round(avg((s > 1)::INT), 6) AS faster_rate, count(*) FILTER (WHERE t) AS tails_recovered, count(*) FILTER (WHERE e) AS ends_recovered, round(avg(n), 6) AS numbers_change FROM m""",
    "must_keep_terms": "WITH o AS (SELECT category, target, coalesce(must_keep, []) AS m, coalesce(tail_keep, []) AS t FROM long_documents WHERE target IS NOT NULL) SELECT category, count(*) AS documents, sum(len(m)) AS terms, sum(len(list_filter(m, lambda x: NOT contains(target, x)))) AS missing, count(*) FILTER (WHERE len(list_filter(t, lambda x: NOT contains(target, x))) = 0) AS tails_kept FROM o GROUP BY 1",
}
QUERIES = (
    pair_statistics, length_percentiles, length_relations, length_bins, topic_risk, newest_decision_reasons, merged_targets, pair_issue_report, candidate_decisions, removed_line_rerank, identity_rows, pair_ngram_jaccard,
    sari_scores, number_scores, alignment_scores, surface_similarity, paired_outcomes, wilson_by_origin, calibration, bootstrap_ci, scorecard, mode_comparison, paired_difference, must_keep_terms,
)
