"""Corpus cleaning end to end: scan, normalise, judge, cut, drop duplicates, report; its queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import udfs
from ..operators import dedup, quality
from ..session import materialize, table

ORDER = ["source_file", "source_row", "record_id"]


def clean_corpus(records: DataFrame, policies: DataFrame, seed: DataFrame | None = None) -> DataFrame:
    """One row a chunk with ``reason``: null for those kept, else why it was dropped.

    Columns: record_id, source, score, source_file, source_row, chunk_index, text, reason. Records dropped before
    they are cut have chunk_index null. Each source's policy holds; duplicates are dropped within equal digests of
    all sources, the first by source_file, source_row, record_id and chunk_index wins. ``seed`` (digest) drops what an
    earlier corpus holds. Null texts aren't records and have no row; a null source is ``unknown``.
    """
    p = quality.policy_columns()
    own = quality.join_policies(records.filter("text is not null"), policies)
    own = own.withColumn("source", F.when(F.coalesce(F.trim("source"), F.lit("")) == "", "unknown").otherwise(F.col("source")))
    folded = F.coalesce(udfs.nfkc(F.when(p["normalize_unicode"], F.col("text"))), F.col("text"))
    own = own.withColumn("text", tx.clean_text(folded)).withColumn("_early", quality.record_reason("score", "text", p))
    cut = udfs.chunks(F.when(F.col("_early").isNull(), F.col("text")), p["max_chars"], p["min_chars"])
    own = own.withColumn("_chunks", cut)
    own = own.withColumn("_early", F.coalesce("_early", F.when(F.size("_chunks") == 0, "no_valid_chunk")))
    rows = own.select("record_id", "source", "score", "source_file", "source_row", "policy", "_early", F.posexplode_outer("_chunks").alias("chunk_index", "text"))
    rows = rows.withColumn("reason", F.coalesce("_early", quality.text_reason("text", p))).withColumn("_mode", p["dedupe_mode"])
    rows = materialize(rows.drop("policy", "_early"), "chunks")
    digest = F.when(F.col("reason").isNull(), tx.dedupe_digest("text", F.col("_mode")))
    rows = rows.withColumn("_digest", digest)
    if seed is not None:
        known = seed.select(F.col("digest").alias("_digest"), F.lit(True).alias("_known")).distinct()
        rows = rows.join(known, "_digest", "left")
        rows = rows.withColumn("reason", F.coalesce("reason", F.when(F.col("_known"), F.concat(F.lit("duplicate_against_seed_"), "_mode")))).drop("_known")
        rows = rows.withColumn("_digest", F.when(F.col("reason").isNull(), F.col("_digest")))
    rows = dedup.mark_duplicates(rows, "_digest", [*ORDER, "chunk_index"])
    reason = F.coalesce("reason", F.when(F.col("duplicate"), F.concat(F.lit("duplicate_"), "_mode")))
    return rows.select("record_id", "source", "score", "source_file", "source_row", "chunk_index", "text", reason.alias("reason"))


def cleaning_report(cleaned: DataFrame) -> DataFrame:
    """Chunks and characters by reason (``kept`` for those kept): count, least, most and mean length."""
    n = F.length("text")
    return cleaned.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(
        F.count("*").alias("rows"), F.min(n).alias("min_chars"), F.max(n).alias("max_chars"), F.bround(F.avg(n), 4).alias("mean_chars")
    )


# --- queries -----------------------------------------------------------------------------------------


def _cleaned(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "text_records").filter("text is not null").withColumn("t", tx.clean_text("text"))


def clean_reject_report(spark, d):
    """Reasons by source's policy without folding and cutting, duplicates by digest; first copy wins."""
    p = quality.policy_columns()
    own = quality.join_policies(_cleaned(spark, d), table(spark, d, "cleaning_policies"))
    own = own.withColumn("v", tx.visible_chars("t"))
    own = own.withColumn("reason", F.coalesce(quality.record_reason("score", "t", p), quality.text_reason("t", p, F.col("v")))).withColumn("mode", p["dedupe_mode"])
    own = own.select("record_id", "source_file", "source_row", "reason", "mode", F.when(F.col("reason").isNull(), tx.dedupe_digest("t", F.col("mode"))).alias("digest"))
    own = dedup.mark_duplicates(materialize(own, "reasons"), "digest", ORDER)  # judged once, read twice
    reason = F.coalesce("reason", F.when(F.col("duplicate"), F.concat(F.lit("duplicate_"), "mode")), F.lit("kept"))
    return own.groupBy(reason.alias("reason")).agg(F.count("*").alias("rows"))


def corpus_cleaning(spark, d):
    return cleaning_report(clean_corpus(table(spark, d, "text_records"), table(spark, d, "cleaning_policies")))


def corpus_cleaning_incremental(spark, d):
    """The newer half of the deliveries against the digests of the older half."""
    records = table(spark, d, "text_records")
    old = F.coalesce(F.col("ingested_at") < F.lit("2025-07-01").cast("timestamp"), F.lit(False))
    seed = records.filter(old & F.col("text").isNotNull()).select(tx.dedupe_digest(tx.clean_text("text"), "normalized").alias("digest"))
    return cleaning_report(clean_corpus(records.filter(~old), table(spark, d, "cleaning_policies"), seed))


def quality_ratios(spark, d):
    r = lambda c: F.round(c, 6)
    v = F.col("v")
    return _cleaned(spark, d).withColumn("v", tx.visible_chars("t")).select(
        "record_id", r(tx.cjk_ratio("t", v)).alias("cjk"), r(tx.url_ratio("t")).alias("url"), r(tx.html_ratio("t")).alias("html"),
        r(tx.punctuation_ratio("t", v)).alias("punctuation"), r(tx.digit_ratio("t", v)).alias("digits"), r(tx.repeated_line_ratio("t")).alias("repeated_lines"),
    )


def char_class_profile(spark, d):
    n = lambda p: F.sum(tx.matched_chars("t", p)).alias
    return _cleaned(spark, d).groupBy(F.lower(F.trim("source")).alias("source")).agg(
        F.count("*").alias("texts"), n(tx.HAN)("han"), n(r"\p{Nd}")("digits"), n(r"\p{P}")("punctuation"), n(r"[A-Za-z]")("latin"), F.sum(F.length("t")).alias("chars"), F.sum(F.octet_length("t")).alias("bytes")
    )


def normalizer_profile(spark, d):
    """How many distinct texts each normaliser leaves."""
    own = _cleaned(spark, d)
    forms = {"clean": F.col("t"), "dedupe": tx.dedupe_form("t"), "compact": tx.compact("t"), "surface": tx.surface("t"), "answer": tx.answer_form("t")}
    kinds = own.select(F.explode(F.array(*(F.struct(F.lit(k).alias("form"), F.md5(v).alias("h"), F.length(v).alias("n")) for k, v in forms.items()))).alias("f"))
    return kinds.groupBy("f.form").agg(F.count_distinct("f.h").alias("distinct_texts"), F.sum("f.n").alias("chars"))


def exact_dedup_first_wins(spark, d):
    own = _cleaned(spark, d).select("record_id", "source_file", "source_row", F.sha2("t", 256).alias("digest"))
    return dedup.first_wins(own, "digest", ORDER).select("record_id", "source_file", "source_row")


def normalized_dedup_first_wins(spark, d):
    own = _cleaned(spark, d).select("record_id", "source_file", "source_row", F.sha2(tx.dedupe_form("t"), 256).alias("digest"))
    return dedup.first_wins(own, "digest", ORDER).select("record_id", "source_file", "source_row")


def seed_anti_dedup(spark, d):
    """Records of other sources that no record of wiki sources repeats."""
    own = _cleaned(spark, d).withColumn("s", F.lower(F.trim("source"))).withColumn("digest", F.sha2(tx.dedupe_form("t"), 256)).select("record_id", "s", "digest")
    return dedup.against_seed(own.filter("not coalesce(s, '') like 'wiki%'"), "digest", own.filter("s like 'wiki%'")).select("record_id")


def dedup_bucket_skew(spark, d):
    """Rows and distinct digests by the digest's first byte."""
    digest = F.sha2(tx.dedupe_form("t"), 256)
    return _cleaned(spark, d).select(digest.alias("h")).groupBy(F.conv(F.substring("h", 1, 2), 16, 10).cast("int").alias("bucket")).agg(F.count("*").alias("rows"), F.count_distinct("h").alias("digests"))


def duplicate_audit(spark, d):
    own = _cleaned(spark, d).select("record_id", "source_file", "source_row", F.sha2("t", 256).alias("e"), F.sha2(tx.dedupe_form("t"), 256).alias("n"))
    more = lambda c: (F.count("*") - F.count_distinct(c)).cast("bigint")
    return own.agg(more(F.col("e")).alias("exact"), more(F.col("n")).alias("normalized"), more(F.struct("source_file", "source_row")).alias("deliveries"), more(F.col("record_id")).alias("ids"))


def simhash_near_dup(spark, d):
    """The class of each text and whether an earlier kept text is nearly the same."""
    return dedup.simhash_near_duplicates(table(spark, d, "text_records"), "record_id", "text")


def anchor_jaccard_near_dup(spark, d):
    """Sources of all pairs outside train, those without a split included, against training sources."""
    own = table(spark, d, "pair_records").withColumn("split", F.lower(F.trim("split")))
    return dedup.anchor_overlap(own.filter("split is null or split <> 'train'"), own.filter("split = 'train'"), "pair_id", "pair_id", "source", "source")


def chunk_documents(spark, d):
    own = table(spark, d, "long_documents").filter("source is not null")
    pieces = udfs.chunks(tx.clean_text("source"), F.lit(512), F.lit(40))
    return own.select("document_id", F.posexplode(pieces).alias("chunk_index", "text")).select("document_id", "chunk_index", F.length("text").alias("chars"), F.md5("text").alias("digest"))


def sentence_split(spark, d):
    """Sentences of each document; put together they are the document again."""
    own = table(spark, d, "long_documents").filter("source is not null").withColumn("s", udfs.sentences("source"))
    return own.groupBy("category").agg(F.count("*").alias("documents"), F.sum(F.size("s")).alias("sentences"), F.count_if(F.array_join("s", "") == F.col("source")).alias("lossless"))


def utf8_parts(spark, d):
    own = table(spark, d, "long_documents").filter("source is not null").withColumn("p", udfs.utf8_parts("source", F.lit(256)))
    return own.agg(F.sum(F.size("p")).alias("parts"), F.max(F.array_max(F.transform("p", F.octet_length))).alias("widest"), F.count_if(F.array_join("p", "") == F.col("source")).alias("lossless"))


def repetition_profile(spark, d):
    """Share of repeated 4-grams of each document."""
    own = table(spark, d, "documents").filter("text is not null").select("doc_id", "category", F.round(tx.repetition_ratio("text"), 6).alias("repetition"))
    return own


_C = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '[\x{{feff}}\x{{200b}}-\x{{200f}}\x{{2060}}]', '', 'g'), '\r\n?', chr(10), 'g'), '[\x00-\x08\x0b-\x1f\x7f-\x{{9f}}\p{{Cf}}\p{{Co}}]', ' ', 'g'),
    '[ \t\x{{a0}}\x{{3000}}]+', ' ', 'g'), '[\s\p{{Z}}]*\n[\s\p{{Z}}]*', chr(10), 'g'), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'))"""
SQL_CLEAN = _C.format("text")
_T = f"WITH c AS (SELECT *, {SQL_CLEAN} AS t FROM text_records WHERE text IS NOT NULL)"
_FORM = r"lower(regexp_replace(t, '[^\p{L}\p{N}]+', '', 'g'))"
_VIS = r"length(regexp_replace(t, '[\s\p{Z}\x{1c}-\x{1f}\x{85}]+', '', 'g'))"
_LEN = lambda p: f"length(regexp_replace(t, '[^{p}]', '', 'g'))"
_HANC = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}"
_LINES = "list_filter(regexp_split_to_array(t, '[\\n\\x{2028}\\x{2029}]'), lambda x: trim(x) <> '')"
_Q = {
    "cjk": f"coalesce({_LEN(_HANC)} / nullif({_VIS}, 0), 0)",
    "url": r"(length(t) - length(regexp_replace(t, '(?i)https?://\S+|www\.\S+', '', 'g'))) / greatest(length(t), 1)",
    "html": r"(length(t) - length(regexp_replace(t, '<[^>\n]{1,120}>', '', 'g'))) / greatest(length(t), 1)",
    "punctuation": f"coalesce({_LEN(chr(92) + 'p{P}')} / nullif({_VIS}, 0), 0)",
    "digits": "coalesce(" + _LEN(r"\p{Nd}\x{b2}-\x{b3}\x{b9}\x{1369}-\x{1371}\x{19da}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247c}\x{2488}-\x{2490}\x{24ea}\x{24f5}-\x{24fd}\x{24ff}\x{2776}-\x{277e}\x{2780}-\x{2788}\x{278a}-\x{2792}\x{10a40}-\x{10a43}\x{10e60}-\x{10e68}\x{11052}-\x{1105a}\x{1f100}-\x{1f10a}") + f" / nullif({_VIS}, 0), 0)",
    "repeated_lines": f"CASE WHEN len({_LINES}) >= 4 THEN (len({_LINES}) - len(list_distinct({_LINES}))) / len({_LINES}) ELSE 0 END",
}
_REASON = f"""CASE WHEN NOT isnan(coalesce(score, '-inf'::DOUBLE)) AND coalesce(score, '-inf'::DOUBLE) < min_score THEN 'score_below_minimum' WHEN t = '' THEN 'empty_text_after_clean' WHEN contains(t, chr(65533)) THEN 'replacement_character'
    WHEN length(t) < min_chars THEN 'too_short' WHEN length(t) > max_chars THEN 'too_long_after_split' WHEN {_Q["cjk"]} < min_cjk_ratio THEN 'low_cjk_ratio' WHEN {_VIS} = 0 THEN 'empty_text_after_clean'
    WHEN max_url_ratio >= 0 AND {_Q["url"]} > max_url_ratio THEN 'high_url_ratio' WHEN max_html_ratio >= 0 AND {_Q["html"]} > max_html_ratio THEN 'high_html_ratio'
    WHEN max_punctuation_ratio >= 0 AND {_Q["punctuation"]} > max_punctuation_ratio THEN 'high_punctuation_ratio' WHEN max_digit_ratio >= 0 AND {_Q["digits"]} > max_digit_ratio THEN 'high_digit_ratio'
    WHEN max_repeated_line_ratio >= 0 AND {_Q["repeated_lines"]} > max_repeated_line_ratio THEN 'high_repeated_line_ratio' END"""
_POL = """coalesce(p.min_score, 4.0) AS min_score, coalesce(p.min_chars, 200) AS min_chars, coalesce(p.max_chars, 16384) AS max_chars, coalesce(p.min_cjk_ratio, 0.25) AS min_cjk_ratio, coalesce(p.dedupe_mode, 'normalized') AS dedupe_mode,
    coalesce(p.max_repeated_line_ratio, 0.35) AS max_repeated_line_ratio, coalesce(p.max_url_ratio, 0.2) AS max_url_ratio, coalesce(p.max_html_ratio, 0.1) AS max_html_ratio, coalesce(p.max_punctuation_ratio, 0.45) AS max_punctuation_ratio, coalesce(p.max_digit_ratio, 0.35) AS max_digit_ratio"""
_FIRST = "row_number() OVER (PARTITION BY {0} ORDER BY source_file, source_row, record_id)"

SQL = {
    "clean_reject_report": f"""{_T}, j AS (SELECT c.record_id, c.source_file, c.source_row, c.score, c.t, {_POL} FROM c LEFT JOIN (SELECT *, lower(trim(source)) AS s FROM cleaning_policies) p ON lower(trim(c.source)) = p.s),
        r AS (SELECT *, {_REASON} AS reason FROM j), g AS (SELECT *, CASE WHEN reason IS NULL AND dedupe_mode = 'normalized' THEN sha256({_FORM}) WHEN reason IS NULL AND dedupe_mode = 'exact' THEN sha256(t) END AS digest FROM r),
        n AS (SELECT *, CASE WHEN digest IS NOT NULL THEN {_FIRST.format("digest")} ELSE 1 END AS rn FROM g)
        SELECT coalesce(reason, CASE WHEN rn > 1 THEN 'duplicate_' || dedupe_mode END, 'kept') AS reason, count(*) AS rows FROM n GROUP BY 1""",
    "quality_ratios": f"{_T} SELECT record_id, " + ", ".join(f"round({v}, 6) AS {k}" for k, v in _Q.items()) + " FROM c",
    "char_class_profile": f"{_T} SELECT lower(trim(source)) AS source, count(*) AS texts, sum({_LEN(_HANC)}) AS han, sum({_LEN(chr(92) + 'p{Nd}')}) AS digits, sum({_LEN(chr(92) + 'p{P}')}) AS punctuation, sum({_LEN('A-Za-z')}) AS latin, sum(length(t)) AS chars, sum(octet_length(encode(t))) AS bytes FROM c GROUP BY 1",
    "exact_dedup_first_wins": f"{_T} SELECT record_id, source_file, source_row FROM (SELECT *, {_FIRST.format('sha256(t)')} AS rn FROM c) WHERE rn = 1",
    "normalized_dedup_first_wins": f"{_T} SELECT record_id, source_file, source_row FROM (SELECT *, {_FIRST.format(f'sha256({_FORM})')} AS rn FROM c) WHERE rn = 1",
    "seed_anti_dedup": f"{_T}, k AS (SELECT record_id, lower(trim(source)) AS s, {_FORM} AS f FROM c) SELECT record_id FROM k WHERE NOT coalesce(s, '') LIKE 'wiki%' AND f NOT IN (SELECT f FROM k WHERE s LIKE 'wiki%')",
    "dedup_bucket_skew": f"{_T}, k AS (SELECT sha256({_FORM}) AS h FROM c) SELECT CAST('0x' || substr(h, 1, 2) AS INTEGER) AS bucket, count(*) AS rows, count(DISTINCT h) AS digests FROM k GROUP BY 1",
    "duplicate_audit": f"{_T} SELECT count(*) - count(DISTINCT t) AS exact, count(*) - count(DISTINCT {_FORM}) AS normalized, count(*) - count(DISTINCT (source_file, source_row)) AS deliveries, count(*) - count(DISTINCT record_id) AS ids FROM c",
    "normalizer_profile": f"""{_T}, v AS (SELECT t, regexp_replace(t, '[\\s\\p{{Z}}\\x{{0b}}\\x{{1c}}-\\x{{1f}}\\x{{85}}]+', '', 'g') AS c FROM c),
        f AS (SELECT unnest([{{'k': 'clean', 't': t}}, {{'k': 'dedupe', 't': {_FORM}}}, {{'k': 'compact', 't': c}}, {{'k': 'surface', 't': lower(regexp_replace(c, '[^\\p{{L}}\\p{{N}}_\\x{{3400}}-\\x{{9fff}}]+', '', 'g'))}}, {{'k': 'answer', 't': regexp_replace(c, '[。！？.!?]+$', '')}}]) AS x FROM v)
        SELECT x.k AS form, count(DISTINCT x.t) AS distinct_texts, CAST(sum(length(x.t)) AS BIGINT) AS chars FROM f GROUP BY 1""",
    "anchor_jaccard_near_dup": r"""
        WITH f AS (SELECT pair_id, coalesce(lower(trim(split)) = 'train', false) AS train, lower(regexp_replace(source, '[^\p{L}\p{N}]+', '', 'g')) AS f FROM pair_records WHERE source IS NOT NULL),
        k AS (SELECT train, f, min(pair_id) AS id, list_distinct(CASE WHEN length(f) >= 4 THEN list_transform(range(1, length(f) - 2), lambda i: substr(f, i, 4)) ELSE [f] END) AS g FROM f WHERE f <> '' GROUP BY train, f),
        e AS (SELECT train, list_sort(g) AS g, min(id) AS id FROM k GROUP BY 1, 2), x AS (SELECT train, id, len(g) AS n, unnest(g) AS t FROM e),
        j AS (SELECT a.id AS q, b.id AS c, count(*) AS inter, any_value(a.n) AS na, any_value(b.n) AS nb FROM x a JOIN x b ON a.t = b.t WHERE NOT a.train AND b.train GROUP BY 1, 2),
        s AS (SELECT q, c, round(inter / (na + nb - inter), 9) AS jac FROM j WHERE round(inter / (na + nb - inter), 9) >= 0.85), m AS (SELECT q, max(jac) AS jac, arg_max(c, (jac, -c)) AS c FROM s GROUP BY 1),
        w AS (SELECT f.pair_id, e.id AS q FROM f JOIN k ON NOT f.train AND NOT k.train AND f.f = k.f JOIN e ON NOT e.train AND e.g = list_sort(k.g))
        SELECT w.pair_id, m.c AS best_id, m.jac AS jaccard FROM w JOIN m USING (q)""",
    "repetition_profile": r"""WITH k AS (SELECT doc_id, category, regexp_replace(text, '[\s\p{Z}\x{1c}-\x{1f}\x{85}]+', '', 'g') AS t FROM documents WHERE text IS NOT NULL),
        g AS (SELECT doc_id, category, CASE WHEN length(t) >= 4 THEN list_transform(generate_series(1, length(t) - 3), lambda i: substr(t, i, 4)) ELSE [] END AS g FROM k)
        SELECT doc_id, category, round(coalesce((len(g) - len(list_distinct(g))) / nullif(len(g), 0), 0), 6) AS repetition FROM g""",
}
QUERIES = (
    clean_reject_report, corpus_cleaning, corpus_cleaning_incremental, quality_ratios, char_class_profile, normalizer_profile, exact_dedup_first_wins, normalized_dedup_first_wins, seed_anti_dedup,
    dedup_bucket_skew, duplicate_audit, simhash_near_dup, anchor_jaccard_near_dup, chunk_documents, sentence_split, utf8_parts, repetition_profile,
)
