"""Evaluation: choices, language-model measures, comparisons, templates and perturbations; queries and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import forms, udfs
from ..functions import text as tx
from ..operators import profiles, ranking
from ..session import table
from .pairs import _N, _P, _pairs, newest_decisions

# Patterns that rule chat texts out, in order.
BANS = {"visible_think_tags": "(?i)</?think>|</?analysis>", "foreign_chat_marker": r"(?i)<tool_(?:call|response)>|<\|im_(?:start|end)\|>", "replacement_character": r"\x{fffd}", "control_character": r"[\x00-\x08\x0b-\x1f]"}


def choose(df: DataFrame, scores: str, answer: str) -> DataFrame:
    """The rows with ``picked`` (place of the highest score, the first of equals), ``correct`` and ``chance``."""
    own = df.withColumn("picked", (F.array_position(scores, F.array_max(scores)) - 1).cast("int"))
    return own.withColumn("correct", F.col("picked") == F.col(answer)).withColumn("chance", 1 / F.size(scores))


def mean_centred(df: DataFrame, id_col: str, scores: str, answer: str) -> DataFrame:
    """(id, picked, correct) after each place's mean score is taken off; the means know no answers."""
    long = df.select(id_col, answer, F.posexplode(scores).alias("place", "score"))
    means = long.groupBy("place").agg(F.avg("score").alias("m"))  # one row a place
    gap = F.round(F.col("score") - F.col("m"), 9)
    best = long.join(F.broadcast(means), "place").groupBy(id_col, answer).agg(F.max_by("place", F.struct(gap, -F.col("place"))).alias("picked"))
    return best.select(id_col, F.col("picked").cast("int").alias("picked"), (F.col("picked") == F.col(answer)).alias("correct"))


def choice_summary(chosen: DataFrame, category: str) -> DataFrame:
    """(category, n, accuracy, chance, adjusted_percent, low, high); null categories are ``unknown``."""
    by = chosen.groupBy(F.coalesce(F.col(category), F.lit("unknown")).alias("category")).agg(F.count("*").alias("n"), F.count_if("correct").alias("hits"), F.avg("chance").alias("c"))
    low, high = profiles.wilson(F.col("hits"), F.col("n"))
    acc = F.col("hits") / F.col("n")
    return by.select("category", "n", F.round(acc, 6).alias("accuracy"), F.round("c", 6).alias("chance"), F.round(F.try_divide(100 * (acc - F.col("c")), 1 - F.col("c")), 4).alias("adjusted_percent"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def language_model_measures(df: DataFrame, keys: list[str], loss: str, n_tokens: str, n_bytes: str) -> DataFrame:
    """Token-weighted cross entropy (nats), perplexity, bits a token and a byte."""
    ce = F.sum(F.col(loss) * F.col(n_tokens)) / F.sum(n_tokens)
    return df.groupBy(*keys).agg(F.sum(n_tokens).alias("tokens"), F.round(ce, 6).alias("ce"), F.round(F.exp(F.least(ce, F.lit(50.0))), 4).alias("ppl"), F.round(ce / F.log(F.lit(2.0)), 6).alias("bits_per_token"), F.round(F.sum(F.col(loss) * F.col(n_tokens)) / F.log(F.lit(2.0)) / F.sum(n_bytes), 6).alias("bits_per_byte"))


# --- queries -----------------------------------------------------------------------------------------


def _choices(spark: SparkSession, d: str) -> DataFrame:
    """Three texts of each pair scored by their distance from two thirds of the source's length; the target is right."""
    new = newest_decisions(table(spark, d, "quality_decisions")).select("pair_id", "candidate").filter("candidate is not null")
    own = _pairs(spark, d).join(new, "pair_id")
    score = lambda c: F.round(-F.abs(F.length(c) / F.length("source") - 0.66), 9)
    return own.select("pair_id", "origin", F.array(score("source"), score("candidate"), score("target")).alias("scores"), F.lit(2).alias("answer"))


def choice_accuracy(spark, d):
    return choice_summary(choose(_choices(spark, d), "scores", "answer"), "origin")


def choice_mean_centred(spark, d):
    got = mean_centred(_choices(spark, d), "pair_id", "scores", "answer")
    return got.groupBy("picked").agg(F.count("*").alias("n"), F.count_if("correct").alias("correct"))


def language_model_report(spark, d):
    """Scores of documents taken as losses, characters as tokens."""
    own = table(spark, d, "documents").filter("text is not null and length(text) > 0 and score is not null").select("category", "score", F.length("text").alias("n"), F.octet_length("text").alias("b"))
    return language_model_measures(own, ["category"], "score", "n", "b")


def determinism(spark, d):
    """Pairs whose decisions all hold the same candidate, among those decided more than once."""
    own = table(spark, d, "quality_decisions").groupBy("pair_id").agg(F.count("*").alias("n"), F.count_distinct(F.coalesce("candidate", F.lit(""))).alias("k")).filter("n > 1")
    return own.agg(F.count("*").alias("repeated"), F.count_if(F.col("k") == 1).alias("same"))


def efficiency(spark, d):
    """Mean length ratio by origin against the best origin."""
    own = _pairs(spark, d).groupBy(F.coalesce("origin", F.lit("unknown")).alias("origin")).agg((F.sum(F.length("target")) / F.sum(F.length("source"))).alias("r"))
    return own.select("origin", F.round("r", 6).alias("ratio"), F.round(F.min("r").over(Window.partitionBy(F.lit(0))) / F.col("r"), 6).alias("of_best"))


def stratified_summary(spark, d):
    """Pairs by three overlapping dimensions at once: length, numbers, change."""
    bucket = F.when(F.length("source") <= 120, "short").when(F.length("source") <= 240, "medium").otherwise("long")
    dims = F.array(*(F.struct(F.lit(k).alias("dimension"), v.alias("bucket")) for k, v in (("length", bucket), ("numbers", F.when(F.regexp_like("source", F.lit(r"\p{Nd}")), "some").otherwise("none")), ("action", F.when(F.col("source") == F.col("target"), "kept").otherwise("rewritten")))))
    own = _pairs(spark, d).select(F.explode(dims).alias("x"), tx.ratio(F.length("target"), F.length("source")).alias("r"))
    return own.groupBy("x.dimension", "x.bucket").agg(F.count("*").alias("pairs"), F.round(F.avg("r"), 6).alias("ratio"))


def extreme_differences(spark, d):
    """The eight pairs that shrink most and the eight that grow most."""
    own = _pairs(spark, d).select("pair_id", (F.length("target") - F.length("source")).alias("more"))
    low = own.orderBy("more", "pair_id").limit(8).withColumn("end", F.lit("shrunk"))
    return low.unionByName(own.orderBy(F.col("more").desc(), "pair_id").limit(8).withColumn("end", F.lit("grown")))


def perturbation_consistency(spark, d):
    """Similarity of each pair's target with its own three perturbations, by kind."""
    g = lambda c: F.array_distinct(tx.char_ngrams(tx.dedupe_form(c), 4))
    own = _pairs(spark, d).select("pair_id", "target", F.explode(forms.perturbed(F.col("target"))).alias("p"))
    own = own.select("p.kind", F.round(tx.jaccard(g("target"), g("p.text")), 6).alias("j"))
    return own.groupBy("kind").agg(F.count("*").alias("pairs"), F.round(F.avg("j"), 6).alias("mean"), F.min("j").alias("least"))


def template_masks(spark, d):
    """Source and target under their labels: characters, labelled ones, pairs that a label rules out."""
    own = _pairs(spark, d).select("split", forms.source_target(F.col("source"), F.col("target")).alias("x"))
    return own.groupBy("split").agg(F.count("*").alias("pairs"), F.count_if(F.col("x").isNull()).alias("ruled_out"), F.sum(F.length("x.text")).alias("chars"), F.sum(F.regexp_count("x.mask", F.lit("1"))).alias("labelled"))


def prompt_forms(spark, d):
    own = _pairs(spark, d).select("pair_id", forms.alpaca(F.lit("简化下面的句子。"), F.col("source"), F.col("target")).alias("a"), forms.lettered(F.col("source"), F.array("target", "source")).alias("l"))
    return own.select("pair_id", F.md5("a").alias("alpaca"), F.md5("l").alias("lettered"))


def pattern_bans(spark, d):
    own = table(spark, d, "documents").filter("text is not null")
    return own.groupBy(F.coalesce(forms.pattern_reason(F.col("text"), BANS), F.lit("none")).alias("reason")).agg(F.count("*").alias("docs"))


def detokenized_texts(spark, d):
    own = table(spark, d, "text_records").filter("text is not null").select("record_id", F.length(forms.detokenized(F.col("text"))).alias("chars"))
    return own


def chunk_plan(spark, d):
    """Sentences of long documents packed under 160 characters; put together they are the document."""
    own = table(spark, d, "long_documents").filter("source is not null").withColumn("c", forms.plan_chunks("source", F.lit(160)))
    return own.groupBy("layout").agg(F.count("*").alias("documents"), F.sum(F.size("c")).alias("chunks"), F.max(F.array_max(F.transform("c", F.length))).alias("longest"), F.count_if(F.array_join("c", "") == F.col("source")).alias("lossless"))


def hashed_windows(spark, d):
    own = table(spark, d, "documents").filter("text is not null").select("doc_id", forms.ordinal_windows(F.col("text"), F.col("doc_id"), 512).alias("w"))
    return own.agg(F.count("*").alias("windows"), F.max(F.length("w")).alias("longest"), F.sum(F.length("w")).alias("chars"))


def epoch_shards(spark, d):
    """The second epoch's order by hash, dealt to four ranks by turns."""
    own = table(spark, d, "documents").select("doc_id", ranking.hash_score(ranking_seed() + 1, F.col("doc_id")).alias("h"))
    got = ranking.global_rank(own, ["h", "doc_id"])
    return got.select("doc_id", (F.col("rank") % 4).cast("int").alias("rank"), F.floor(F.col("rank") / 4).cast("bigint").alias("place"))


def ranking_seed() -> int:
    return 20260809


def blake_split(spark, d):
    own = table(spark, d, "documents").filter("text is not null").select("doc_id", udfs.blake_fraction("text").alias("f"))
    return own.groupBy(F.when(F.col("f") < 0.1, "validation").otherwise("train").alias("split")).agg(F.count("*").alias("docs"))


_SC = lambda c: f"round(-abs(length({c}) / length(source) - 0.66), 9)"
_CH = f"{_P}, {_N}, c AS (SELECT pair_id, origin, [{_SC('source')}, {_SC('candidate')}, {_SC('target')}] AS s FROM p JOIN (SELECT pair_id, candidate FROM n WHERE candidate IS NOT NULL) n USING (pair_id))"
SQL = {
    "choice_accuracy": f"{_CH}, k AS (SELECT coalesce(origin, 'unknown') AS category, list_position(s, list_max(s)) = 3 AS ok FROM c), a AS (SELECT category, count(*) AS n, count(*) FILTER (WHERE ok) AS h FROM k GROUP BY 1), w AS (SELECT *, h / n AS q, 1.959963984540054::DOUBLE AS z FROM a) SELECT category, n, round(q, 6) AS accuracy, round(1 / 3::DOUBLE, 6) AS chance, round(100 * (q - 1 / 3::DOUBLE) / (1 - 1 / 3::DOUBLE), 4) AS adjusted_percent, round(greatest(0, (q + z * z / (2 * n) - z * sqrt(q * (1 - q) / n + z * z / (4.0 * n * n))) / (1 + z * z / n)), 6) AS low, round(least(1, (q + z * z / (2 * n) + z * sqrt(q * (1 - q) / n + z * z / (4.0 * n * n))) / (1 + z * z / n)), 6) AS high FROM w",
    "choice_mean_centred": f"{_CH}, m AS (SELECT avg(s[1]) AS a, avg(s[2]) AS b, avg(s[3]) AS c FROM c), g AS (SELECT pair_id, [round(s[1] - a, 9), round(s[2] - b, 9), round(s[3] - m.c, 9)] AS t FROM c, m), k AS (SELECT list_position(t, list_max(t)) - 1 AS picked FROM g) SELECT picked, count(*) AS n, count(*) FILTER (WHERE picked = 2) AS correct FROM k GROUP BY 1",
    "language_model_report": "WITH o AS (SELECT category, score, length(text) AS n, octet_length(encode(text)) AS b FROM documents WHERE text IS NOT NULL AND length(text) > 0 AND score IS NOT NULL), g AS (SELECT category, sum(n) AS tokens, sum(score * n) AS l, sum(b) AS b FROM o GROUP BY 1) SELECT category, tokens, round(l / tokens, 6) AS ce, round(exp(least(l / tokens, 50)), 4) AS ppl, round(l / tokens / ln(2), 6) AS bits_per_token, round(l / ln(2) / b, 6) AS bits_per_byte FROM g",
    "determinism": "WITH g AS (SELECT pair_id, count(*) AS n, count(DISTINCT coalesce(candidate, '')) AS k FROM quality_decisions GROUP BY 1 HAVING count(*) > 1) SELECT count(*) AS repeated, count(*) FILTER (WHERE k = 1) AS same FROM g",
    "efficiency": f"{_P}, g AS (SELECT coalesce(origin, 'unknown') AS origin, sum(length(target)) / sum(length(source)) AS r FROM p GROUP BY 1) SELECT origin, round(r, 6) AS ratio, round(min(r) OVER () / r, 6) AS of_best FROM g",
    "stratified_summary": f"{_P}, o AS (SELECT *, length(target) / length(source) AS r FROM p), x AS (SELECT 'length' AS dimension, CASE WHEN length(source) <= 120 THEN 'short' WHEN length(source) <= 240 THEN 'medium' ELSE 'long' END AS bucket, r FROM o UNION ALL SELECT 'numbers', CASE WHEN regexp_matches(source, '\\p{{Nd}}') THEN 'some' ELSE 'none' END, r FROM o UNION ALL SELECT 'action', CASE WHEN source = target THEN 'kept' ELSE 'rewritten' END, r FROM o) SELECT dimension, bucket, count(*) AS pairs, round(avg(r), 6) AS ratio FROM x GROUP BY 1, 2",
    "extreme_differences": f"{_P}, o AS (SELECT pair_id, length(target) - length(source) AS more FROM p) SELECT pair_id, more, 'shrunk' AS \"end\" FROM (SELECT * FROM o ORDER BY more, pair_id LIMIT 8) UNION ALL SELECT pair_id, more, 'grown' FROM (SELECT * FROM o ORDER BY more DESC, pair_id LIMIT 8)",
    "template_masks": f"{_P}, b AS (SELECT split, trim(source, ' ' || chr(9) || chr(10) || chr(13) || chr(12288) || chr(160)) AS s, trim(target, ' ' || chr(9) || chr(10) || chr(13) || chr(12288) || chr(160)) AS t FROM p), k AS (SELECT *, contains(s, '简写：') OR contains(t, '简写：') OR s = '' OR t = '' AS bad FROM b) SELECT split, count(*) AS pairs, count(*) FILTER (WHERE bad) AS ruled_out, sum(length(s) + 3 + length(t)) FILTER (WHERE NOT bad) AS chars, sum(length(t)) FILTER (WHERE NOT bad) AS labelled FROM k GROUP BY 1",
    "prompt_forms": f"{_P} SELECT pair_id, md5('### Instruction:' || chr(10) || '简化下面的句子。' || CASE WHEN trim(source) <> '' THEN chr(10) || chr(10) || '### Input:' || chr(10) || source ELSE '' END || chr(10) || chr(10) || '### Response:' || chr(10) || target) AS alpaca, md5(source || chr(10) || 'A. ' || target || chr(10) || 'B. ' || source) AS lettered FROM p",
    "pattern_bans": "SELECT CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{k}'" for k, p in BANS.items()) + " ELSE 'none' END AS reason, count(*) AS docs FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "epoch_shards": "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('20260810:' || doc_id), doc_id) - 1 AS r FROM documents) SELECT doc_id, CAST(r % 4 AS INT) AS rank, CAST(floor(r / 4) AS BIGINT) AS place FROM r",
}
QUERIES = (
    choice_accuracy, choice_mean_centred, language_model_report, determinism, efficiency, stratified_summary, extreme_differences, perturbation_consistency, template_masks, prompt_forms, pattern_bans, detokenized_texts, chunk_plan,
    hashed_windows, epoch_shards, blake_split,
)
