"""Problem 4: texts over a limit, cut at natural boundaries with overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_rows

#: What ends a sentence or a part of one, what may close after it, and blanks.
SENTENCE_END, COMMA, CLOSER = "。！？!?；;…", "，,、", "”’」』）)】》\"'"
BLANKS = "\\s\\u2028\\u2029\\u3000\\u00a0"
BOUNDARY = f"[{SENTENCE_END}{COMMA}{BLANKS}]"
#: A parameter table of limits has at most so many rows.
MOST_LIMITS = 1000


def piece_pattern(full: int, overlap: int) -> str:
    """The regex whose matches, one after the other, are the whole text in runs.

    The first run has at most ``full`` characters, each other at most ``full - overlap``. The alternatives stand in
    order of strength: the rest if it fits; a sentence end or line break, a comma, a blank, any of these in the far
    half of the limit; the same in the near half. Where there is none, a run goes on to the next one (or the end)
    within ``full``, which leaves less room for overlap; where that has none either, any character ends it.
    """
    sentence = f"(?:(?<=[{SENTENCE_END}\\n\\r]|[{SENTENCE_END}][{CLOSER}])(?![{CLOSER}{SENTENCE_END}])|(?<=[.])(?=\\s))"
    ends = (sentence, f"(?<=[{COMMA}])", f"(?<=[{BLANKS}])", f"(?<={BOUNDARY})")

    def within(limit: int) -> list[str]:
        half = max(1, limit // 2)
        return [f".{{1,{limit}}}\\z", *(f".{{{half},{limit}}}{e}" for e in ends), *(f".{{1,{half}}}{e}" for e in ends)]

    stride = full - overlap
    first = [*within(full), f".{{{full}}}(?={BOUNDARY})", f".{{1,{full}}}"]
    beyond = [f".{{{stride + 1},{full}}}?(?<={BOUNDARY})", f".{{1,{full}}}\\z"] if overlap else []
    others = [*within(stride), *beyond, f".{{{full}}}(?={BOUNDARY})", f".{{1,{stride}}}"]
    return f"(?s)\\A(?:{'|'.join(first)})|{'|'.join(others)}"


def split_oversized(
    docs: DataFrame, limits: DataFrame, id_col: str = "document_id", text_col: str = "source", key_col: str = "category", order_col: str = "added_at"
) -> DataFrame:
    """(id, max_chars, overlap_chars, pieces): one row for each document over its limit.

    pieces is an array of (at, own, piece, natural): the piece's own first character (from 1), how many
    characters are its own, its text with the overlap before them, and whether it ends at a boundary: behind or just
    before a sentence end, line break, comma or blank, or at the text's end. A piece is not natural only in a stretch
    of more than max_chars characters without any of these.
    A piece never has more than max_chars code points. Each but the first repeats the overlap_chars characters that
    stand before it: fewer where less stands there, or where its own characters, which run to the next boundary,
    leave less room.

    Lengths are counted from the text; claimed counts aren't used. Null and empty texts and documents
    whose category has no limit aren't cut and have no row. A document delivered again counts once, with
    its newest delivery (ties: the greater text). An overlap not below the limit is taken as limit - 1.
    """
    lim = limits.select(F.col(key_col).alias("_key"), F.col("max_chars").alias("max_chars"), F.col("overlap_chars").alias("_o")).filter("max_chars > 0")
    lim = lim.groupBy("_key").agg(F.min("max_chars").alias("max_chars"), F.max("_o").alias("_o"))
    lim = lim.select("_key", "max_chars", F.least(F.greatest(F.coalesce("_o", F.lit(0)), F.lit(0)), F.col("max_chars") - 1).alias("overlap_chars"))
    kinds = sorted({(r.max_chars, r.overlap_chars) for r in small_rows(lim.select("max_chars", "overlap_chars").distinct(), MOST_LIMITS)})
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(key_col).alias("_key"), F.col(order_col).alias("_at"))
    own = own.join(F.broadcast(lim), "_key").filter(F.length("_text") > F.col("max_chars"))  # lim has at most MOST_LIMITS pairs of limits
    own = own.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_id")  # few bytes, much work: not to be coalesced
    newest = Window.partitionBy("_id").orderBy(F.col("_at").desc_nulls_last(), F.col("_text").desc())
    own = own.withColumn("_rn", F.row_number().over(newest)).filter("_rn = 1")
    runs: Column = F.lit(None).cast("array<string>")
    for full, overlap in kinds:  # a literal pattern for each pair of limits
        runs = F.when((F.col("max_chars") == full) & (F.col("overlap_chars") == overlap), F.regexp_extract_all("_text", F.lit(piece_pattern(full, overlap)), F.lit(0))).otherwise(runs)
    # characters of four bytes each: a piece is then cut out without counting from the text's start
    cut = own.withColumn("_runs", runs).withColumn("_wide", F.encode("_text", "UTF-32"))
    step = lambda acc, x: F.struct((acc["next"] + F.length(x)).alias("next"), F.concat(acc["ats"], F.array(acc["next"])).alias("ats"))
    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<int>").alias("ats"))
    cut = cut.withColumn("_ats", F.aggregate("_runs", start, step)["ats"])
    size = F.size("_runs")

    def piece(run: Column, i: Column) -> Column:
        at, many = F.col("_ats")[i], F.length(run)
        back = F.least(F.col("overlap_chars"), F.col("max_chars") - many, at - 1)
        natural = F.rlike(F.right(F.rtrim(run, F.lit(CLOSER)), F.lit(1)), F.lit(BOUNDARY)) | (i + 1 == size) | F.rlike(F.left(F.col("_runs")[F.least(i + 1, size - 1)], F.lit(1)), F.lit(BOUNDARY))
        text = F.decode(F.substring(F.col("_wide"), 4 * (at - back - 1) + 1, 4 * (back + many)), "UTF-32")
        return F.struct(at.alias("at"), many.alias("own"), text.alias("piece"), natural.alias("natural"))

    return cut.select(F.col("_id").alias(id_col), "max_chars", "overlap_chars", F.transform("_runs", piece).alias("pieces"))
