"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import copies, cutoff, defects, overlap, packing, pieces, prose, reading, tokenize


def _kinds(spark: SparkSession, d: str) -> DataFrame:
    return prose.classify_texts(table(spark, d, "text_records"), table(spark, d, "common_words"), table(spark, d, "cleaning_policies"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _kinds(spark, d).filter("kind <> 'prose'").select("record_id", "kind")


def p1_kinds(spark: SparkSession, d: str) -> DataFrame:
    return _kinds(spark, d)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_pairs(table(spark, d, "pair_records"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(table(spark, d, "pair_records"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    got = cutoff.keep_cutoffs(table(spark, d, "text_records"), table(spark, d, "keep_targets"))
    return got.select("source", F.round(F.col("cutoff") * 1000).cast("bigint").alias("cutoff_milli"), "kept_rows")


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    got = pieces.split_oversized(table(spark, d, "long_documents"), table(spark, d, "chunk_limits"))
    return got.select("document_id", F.posexplode("pieces").alias("piece_no", "p")).select("document_id", "piece_no", "p.at", "p.own", "p.piece", "p.natural")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    got = pieces.split_oversized(table(spark, d, "long_documents"), table(spark, d, "chunk_limits"))
    forced = F.exists("pieces", lambda p: ~p["natural"])
    return got.select("document_id", F.when(forced, "forced").otherwise("natural").alias("cut"))


def _copies(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return copies.collapse_copies(table(spark, d, "text_records"), table(spark, d, "cleaning_policies"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _copies(spark, d)[1]


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return _copies(spark, d)[0]


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return defects.flag_pairs(table(spark, d, "pair_records"), table(spark, d, "quality_decisions"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode_corpus(table(spark, d, "documents"))


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_texts(table(spark, d, "documents"), table(spark, d, "pack_sizes"))


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of every packing: all rows packed, none split that fits, no container over its capacity, little space left."""
    packed = packing.pack_texts(table(spark, d, "documents"), table(spark, d, "pack_sizes"))
    own = packed.groupBy("container", "capacity", "doc_id").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens"))
    rows = own.groupBy("container", "capacity").agg(F.count("*").alias("texts"), F.sum("tokens").alias("all"), F.sum(F.when((F.col("tokens") <= F.col("capacity")) & (F.col("n") > 1), 1).otherwise(0)).alias("split_though_fitting"))
    bins = packed.groupBy("container", "bin_id").agg(F.sum("n_tokens").alias("used"), F.first("capacity").alias("capacity"))
    bins = bins.groupBy("container").agg(F.sum((F.col("used") > F.col("capacity")).cast("int")).alias("over_full"), F.count("*").alias("bins"))
    full = F.col("all") >= 0.97 * F.col("bins") * F.col("capacity")
    return rows.join(bins, "container").select("container", "capacity", "texts", "split_though_fitting", "over_full", full.alias("nearly_full"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels")).select("doc_id", "grade")


SQL = {
    "p3_found": """
        WITH r AS (SELECT lower(trim(source)) AS source, score FROM text_records WHERE source IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)),
        g AS (SELECT source, score, count(*) AS n FROM r GROUP BY ALL),
        c AS (SELECT source, score, sum(n) OVER (PARTITION BY source ORDER BY score DESC) AS kept, sum(n) OVER (PARTITION BY source) AS total FROM g)
        SELECT c.source, CAST(round(max(score) * 1000) AS BIGINT) AS cutoff_milli, CAST(min(kept) AS BIGINT) AS kept_rows
        FROM c JOIN (SELECT lower(trim(source)) AS source, keep_percent FROM keep_targets) t ON c.source = t.source
        WHERE 100 * kept >= keep_percent * total GROUP BY c.source""",
    "p8_checks": """
        SELECT container, CAST(max(capacity) AS INTEGER) AS capacity, (SELECT count(*) FROM documents) AS texts, CAST(0 AS BIGINT) AS split_though_fitting, CAST(0 AS BIGINT) AS over_full, true AS nearly_full
        FROM pack_sizes WHERE capacity > 0 GROUP BY container""",
    "p4_found": """
        WITH o AS (SELECT DISTINCT d.document_id, d.source, l.max_chars FROM long_documents d JOIN chunk_limits l USING (category) WHERE length(d.source) > l.max_chars)
        SELECT document_id, max(CASE WHEN len(list_filter(regexp_split_to_array(source, '[。！？!?；;…，,、\\s\\x{3000}\\x{00a0}\\x{2028}\\x{2029}]'), lambda x: length(x) > max_chars)) > 0 THEN 'forced' ELSE 'natural' END) AS cut
        FROM o GROUP BY document_id""",
    "p4_pieces": """
        WITH RECURSIVE d AS (
            SELECT document_id, source AS t, length(source) AS n, max_chars AS m, least(greatest(overlap_chars, 0), max_chars - 1) AS o FROM long_documents JOIN chunk_limits USING (category) WHERE length(source) > max_chars
            QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY added_at DESC NULLS LAST, source DESC) = 1),
        c AS (SELECT document_id, p, substr(t, p, 1) AS ch, substr(t, p + 1, 1) AS nx, CASE WHEN p > 1 THEN substr(t, p - 1, 1) ELSE '' END AS pv FROM d, unnest(range(1, n + 1)) AS u(p)),
        k AS (SELECT *, strpos('。！？!?；;…', ch) > 0 AS is_end, strpos('，,、', ch) > 0 AS is_comma,
                ch IN (' ', chr(9), chr(10), chr(11), chr(12), chr(13), chr(8232), chr(8233), chr(12288), chr(160)) AS is_blank FROM c),
        b AS (SELECT document_id,
                list(p ORDER BY p) FILTER (((is_end OR ch IN (chr(10), chr(13)) OR strpos('”’」』）)】》"' || chr(39), ch) > 0 AND pv <> '' AND strpos('。！？!?；;…', pv) > 0) AND (nx = '' OR strpos('”’」』）)】》"。！？!?；;…' || chr(39), nx) = 0))
                    OR ch = '.' AND nx IN (' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS s1,
                list(p ORDER BY p) FILTER (is_comma) AS s2, list(p ORDER BY p) FILTER (is_blank) AS s3, list(p ORDER BY p) FILTER (is_end OR is_comma OR is_blank) AS s4 FROM k GROUP BY document_id),
        r AS (
            SELECT document_id, -1 AS piece_no, 0 AS beg, 0 AS e FROM d
            UNION ALL
            SELECT document_id, piece_no + 1, e + 1, CASE WHEN n - e <= w THEN n ELSE coalesce(
                list_max(list_filter(s1, lambda x: x BETWEEN e + h AND e + w)), list_max(list_filter(s2, lambda x: x BETWEEN e + h AND e + w)),
                list_max(list_filter(s3, lambda x: x BETWEEN e + h AND e + w)), list_max(list_filter(s4, lambda x: x BETWEEN e + h AND e + w)),
                list_max(list_filter(s1, lambda x: x BETWEEN e + 1 AND e + h)), list_max(list_filter(s2, lambda x: x BETWEEN e + 1 AND e + h)),
                list_max(list_filter(s3, lambda x: x BETWEEN e + 1 AND e + h)), list_max(list_filter(s4, lambda x: x BETWEEN e + 1 AND e + h)),
                list_min(list_filter(s4, lambda x: x BETWEEN e + w + 1 AND e + m)), CASE WHEN n - e <= m THEN n END, CASE WHEN list_contains(s4, e + m + 1) THEN e + m END, e + w) END
            FROM (SELECT *, greatest(1, w // 2) AS h FROM (SELECT r.*, d.n, d.m, CASE WHEN r.e = 0 THEN d.m ELSE d.m - d.o END AS w FROM r JOIN d USING (document_id) WHERE r.e < d.n)) JOIN b USING (document_id))
        SELECT document_id, piece_no, CAST(beg AS INTEGER) AS "at", CAST(e - beg + 1 AS INTEGER) AS own, substr(t, beg - back, back + e - beg + 1) AS piece,
            (e = n OR list_contains(s4, e + 1) OR list_contains(s4, beg - 1 + length(rtrim(substr(t, beg, e - beg + 1), '”’」』）)】》"' || chr(39))))) AS "natural"
        FROM (SELECT *, least(o, m - (e - beg + 1), beg - 1) AS back FROM r JOIN d USING (document_id) JOIN b USING (document_id) WHERE piece_no >= 0)""",
}


def queries():
    return {f.__name__: f for f in (p1_found, p1_kinds, p2_found, p2_report, p3_found, p4_found, p4_pieces, p5_found, p5_groups, p6_found, p7_ids, p8_packed, p8_checks, p9_found)}


def oracle_sql():
    return dict(SQL)
