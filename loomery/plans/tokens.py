"""Token windows, packing and coverage, made-up curricula, event series; queries and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import joins, profiles, tokens
from ..session import table

WIDTH, STRIDE = 256, 128


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null")


def window_starts(spark, d):
    """Windows of each document, one character a token."""
    own = _docs(spark, d).select("doc_id", F.length("text").alias("n"))
    return own.select("doc_id", F.explode(profiles.window_starts(F.col("n"), WIDTH, STRIDE)).alias("start"))


def interval_union_coverage(spark, d):
    own = _docs(spark, d).select("doc_id", F.length("text").alias("n"))
    win = own.select("doc_id", "n", F.explode(profiles.window_starts(F.col("n"), WIDTH, STRIDE)).alias("start")).withColumn("end", F.col("start") + WIDTH)
    return profiles.interval_union(win, ["doc_id"], "start", "end")


def doc_coverage(spark, d):
    """Documents and tokens that windows of some widths can hold."""
    own = _docs(spark, d).agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("tokens"), *(f for w in (256, 512, 1024) for f in (F.count_if(F.length("text") >= w).alias(f"docs_{w}"), F.coalesce(F.sum(F.when(F.length("text") >= w, F.length("text"))), F.lit(0)).alias(f"tokens_{w}"))))
    return own


def unigram_entropy(spark, d):
    chars = _docs(spark, d).select(F.explode(F.split("text", "")).alias("c")).filter("c <> ''")
    return profiles.unigram_entropy(chars, "c")


def char_vocabulary(spark, d):
    return tokens.char_vocabulary(_docs(spark, d), "text")


def char_encoding(spark, d):
    """Length and digest of each document's ids by the vocabulary of all their characters."""
    docs = _docs(spark, d)
    got = tokens.encode_chars(docs, tokens.char_vocabulary(docs, "text", None), "doc_id", "text")
    return got.select("doc_id", F.size("tokens").alias("n"), F.size(F.filter("tokens", lambda x: x == tokens.UNK)).alias("unknown"), F.md5(F.array_join(F.transform("tokens", lambda x: x.cast("string")), ",")).alias("digest"))


def char_round_trip(spark, d):
    """Documents encoded by characters and decoded again."""
    docs = _docs(spark, d)
    vocabulary = tokens.char_vocabulary(docs, "text", None)
    back = tokens.decode_chars(tokens.encode_chars(docs, vocabulary, "doc_id", "text"), vocabulary, "doc_id")
    return back.select("doc_id", F.md5("text").alias("digest"))


def fitted_ids(spark, d):
    """Documents' ids cut and filled to 256: the sum of the last eight, and how many are padding."""
    docs = _docs(spark, d)
    own = tokens.encode_chars(docs, tokens.char_vocabulary(docs, "text", None), "doc_id", "text").select("doc_id", tokens.fit_length(F.col("tokens"), 256, True).alias("t"))
    return own.select("doc_id", F.size("t").alias("n"), F.element_at("t", 256).alias("last"), F.size(F.filter("t", lambda x: x == tokens.PAD)).alias("padding"))


def token_starts(spark, d):
    own = _docs(spark, d).select("doc_id", (F.length("text") + 2).alias("n"))
    return tokens.running_starts(own, "doc_id", "n")


def position_lookup(spark, d):
    """The document at every 1,000th token of all documents put together."""
    starts = tokens.running_starts(_docs(spark, d).select("doc_id", (F.length("text") + 2).alias("n")), "doc_id", "n")
    total = starts.agg(F.max(F.col("start") + F.col("n")).alias("n"))
    points = spark.range(0, total.first()[0] or 0, 1000).select(F.col("id").alias("position"))
    return joins.position_lookup(points, starts, "position", "start", "n", "doc_id", 4096)


def shard_fill(spark, d):
    own = tokens.fill_shards(_docs(spark, d).select("doc_id", F.length("text").alias("n")), "doc_id", "n", 20_000, 200_000)
    return own.groupBy("group", "shard").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"))


def pack_windows(spark, d):
    docs = _docs(spark, d).select("doc_id", F.length("text").alias("n"))
    groups = max(1, -(-docs.count() // 20_000))  # as many as the documents need
    own = tokens.first_fit(docs, "doc_id", "n", F.pmod(F.xxhash64("doc_id"), F.lit(groups)), 2048)
    return own.groupBy("group", "window").agg(F.count("*").alias("pieces"), F.sum("n").alias("tokens"))


def target_masks(spark, d):
    """Of each document's characters, with two of a next document behind them, the places whose target stays inside."""
    ids = F.concat(F.array_repeat(F.lit(1), F.length("text")), F.array(F.lit(2), F.lit(2)))
    return _docs(spark, d).select("doc_id", F.aggregate(tokens.target_mask(ids), F.lit(0), lambda a, x: a + x).alias("inside"))


def math_curriculum(spark: SparkSession) -> DataFrame:
    """(family, number, question, answer): five families of checked arithmetic, numbered through."""
    o = F.col("id").cast("int")
    pick = lambda words: F.element_at(F.array(*map(F.lit, words)), (o % len(words) + 1).cast("int"))
    half = lambda x: F.floor(x / 2).cast("int")
    rows = lambda n, first, family, q, r: spark.range(n).select(F.lit(family).alias("family"), (o + first).cast("bigint").alias("number"), q.alias("question"), r.cast("string").alias("answer"))
    a = o + 20
    b, c = o * 11 % F.greatest(F.lit(2), half(a)) + 1, o * 7 % 30 + 1
    names, things = ("小明", "小华", "小雨", "小林", "小陈", "小周"), ("苹果", "铅笔", "练习本", "糖果", "卡片", "玻璃球")
    add = rows(2400, 0, "add_subtract", F.format_string("%s有%d个%s，送出%d个，又得到%d个，现在有多少个？只回答数字。", pick(names), a, pick(things), b, c), a - b + c)
    groups, each = o % 25 + 2, F.floor(o / 25).cast("int") + 2
    bought = F.format_string("每盒有%d支铅笔，%d盒一共有多少支？只回答数字。", each, groups)
    shared = F.format_string("把%d颗糖平均分给%d人，每人分到多少颗？只回答数字。", groups * each, groups)
    times = rows(2000, 2400, "multiply_divide", F.when(o % 2 == 0, bought).otherwise(shared), F.when(o % 2 == 0, groups * each).otherwise(each))
    percent, base = F.element_at(F.array(*map(F.lit, (5, 10, 15, 20, 25, 30, 40, 50, 60, 75))), (o % 10 + 1).cast("int")), (F.floor(o / 10).cast("int") + 1) * 20
    share = rows(1200, 4400, "percentage", F.format_string("%d的%d%%是多少？只回答数字。", base, percent), F.floor(base * percent / 100).cast("int"))
    hours, minutes = F.floor(o / 60).cast("int") + 1, o % 60
    time = rows(1200, 5600, "time_conversion", F.format_string("%d小时%d分钟一共是多少分钟？只回答数字。", hours, minutes), hours * 60 + minutes)
    x, more = (o + 2) * 6, o * 7 % 25 + 1
    result = F.floor(x / 6).cast("int") + more
    mixed = rows(1200, 6800, "mixed_arithmetic", F.format_string("%d除以6，再加上%d，结果是多少？请给出简短计算过程。", x, more), F.format_string("%d÷6+%d=%d。答案：%d。", x, more, result, result))
    return add.unionByName(times).unionByName(share).unionByName(time).unionByName(mixed)


def synthetic_math(spark, d):
    return math_curriculum(spark)


def language_model_windows(spark, d):
    """Windows of each document's characters as tokens: how many, and how many targets are padding."""
    own = _docs(spark, d).select("doc_id", F.transform(F.filter(F.split("text", ""), lambda x: x != ""), lambda x: F.ascii(x) + 4).alias("t"))
    own = own.select("doc_id", tokens.language_windows(F.concat(F.array(F.lit(1)), "t", F.array(F.lit(2))), 128, 96).alias("w"))
    ignored = F.aggregate("w", F.lit(0), lambda a, x: a + F.size(F.filter(tokens.window_targets(x), lambda y: y == -100)))
    return own.select("doc_id", F.size("w").alias("windows"), ignored.alias("ignored"))


def boundary_profile(spark, d):
    starts = tokens.running_starts(_docs(spark, d).select("doc_id", (F.length("text") + 2).alias("n")), "doc_id", "n")
    return tokens.boundary_stats(starts, "start", "n", 513, 512)


def synthetic_json(spark, d):
    own = spark.range(1000).select("id", F.concat(F.lit("item-"), F.col("id").cast("string")).alias("name"), (F.col("id") * 17 % 101).alias("amount"))
    return own.select("id", F.to_json(F.struct("name", "amount")).alias("answer"), F.concat(F.lit("Give "), "name", F.lit(" with amount "), F.col("amount").cast("string"), F.lit(" as JSON.")).alias("question"))


def loss_acceptance(spark, d):
    """First and last ten events of each type in time: means, drop, and whether the mean fell."""
    own = table(spark, d, "events").filter("value is not null")
    top = lambda cs: F.row_number().over(Window.partitionBy("event_type").orderBy(*cs))
    ends = own.withColumn("a", top([F.col("ts"), F.col("event_id")])).filter("a <= 10").select("event_type", "value", F.lit("first").alias("end"))
    last = own.withColumn("b", top([F.col("ts").desc(), F.col("event_id").desc()])).filter("b <= 10").select("event_type", "value", F.lit("last").alias("end"))
    by = ends.unionByName(last).groupBy("event_type").agg(F.avg(F.when(F.col("end") == "first", F.col("value"))).alias("f"), F.avg(F.when(F.col("end") == "last", F.col("value"))).alias("l"))
    return by.select("event_type", F.round("f", 6).alias("first_mean"), F.round("l", 6).alias("last_mean"), F.round(F.col("f") - F.col("l"), 6).alias("drop"), (F.col("l") < F.col("f")).alias("accepted"))


def loss_guard(spark, d):
    """Events whose mean over the last ten of their type and day passes the first ten's by half."""
    own = table(spark, d, "events").filter("value is not null").withColumn("day", F.to_date("ts"))
    w = Window.partitionBy("event_type", "day").orderBy("ts", "event_id")
    own = own.withColumn("rn", F.row_number().over(w)).withColumn("recent", F.avg("value").over(w.rowsBetween(-9, 0)))
    own = own.withColumn("base", F.avg(F.when(F.col("rn") <= 10, F.col("value"))).over(Window.partitionBy("event_type", "day")))
    return own.filter("rn >= 20 and recent > 1.5 * base").groupBy("event_type").agg(F.count("*").alias("alarms"))


def text_metrics_bits(spark, d):
    """Bits a character and a byte of a unigram model over each language's texts."""
    own = _docs(spark, d).filter("lang is not null").select("lang", F.explode(F.split("text", "")).alias("c")).filter("c <> ''").groupBy("lang", "c").agg(F.count("*").alias("n"))
    w = Window.partitionBy("lang")
    own = own.withColumn("t", F.sum("n").over(w))
    return own.groupBy("lang").agg(F.sum("n").alias("chars"), F.round(-F.sum(F.col("n") * F.log2(F.col("n") / F.col("t"))) / F.sum("n"), 6).alias("bits_per_char"), F.round(-F.sum(F.col("n") * F.log2(F.col("n") / F.col("t"))) / F.sum(F.col("n") * F.octet_length("c")), 6).alias("bits_per_byte"))


def decision_asof(spark, d):
    """Extra: for every decision the accepted flag of the newest earlier decision on its pair."""
    own = table(spark, d, "quality_decisions").filter("decided_at is not null and pair_id is not null")
    left = own.select("decision_id", "pair_id", (F.col("decided_at") - F.expr("interval 1 microsecond")).alias("t"))
    right = own.select("pair_id", F.col("decided_at").alias("rt"), F.col("accepted").alias("before"))
    return joins.asof(left, right, ["pair_id"], "t", "rt", ["before"]).groupBy("before").agg(F.count("*").alias("decisions"))


def event_windows(spark, d):
    """Extra: events by type in stretches of an hour."""
    own = table(spark, d, "events")
    return own.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


_D = "WITH d AS (SELECT doc_id, lang, text, length(text) AS n FROM documents WHERE text IS NOT NULL)"
_W = f"s AS (SELECT doc_id, n, unnest(generate_series(0, n - {WIDTH}, {STRIDE})) AS start FROM d WHERE n >= {WIDTH} UNION ALL SELECT doc_id, n, n - {WIDTH} FROM d WHERE n >= {WIDTH} AND (n - {WIDTH}) % {STRIDE} >= {STRIDE // 2})"
_CH = "c AS (SELECT doc_id, lang, unnest(list_filter(string_split(text, ''), lambda x: x <> '')) AS c FROM d)"
_V = "v AS (SELECT c AS char, row_number() OVER (ORDER BY count(*) DESC, c) + 3 AS id FROM c GROUP BY c)"
_E = "e AS (SELECT * FROM events WHERE value IS NOT NULL)"
SQL = {
    "window_starts": f"{_D}, {_W} SELECT doc_id, start FROM s",
    "interval_union_coverage": f"{_D}, {_W}, b AS (SELECT doc_id, start, start + {WIDTH} AS stop, coalesce(max(start + {WIDTH}) OVER (PARTITION BY doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), start) AS b FROM s) SELECT doc_id, count(*) AS windows, sum(greatest(0, stop - greatest(start, b))) AS covered, sum(stop - start) AS total FROM b GROUP BY 1",
    "doc_coverage": f"{_D} SELECT count(*) AS docs, sum(n) AS tokens, " + ", ".join(f"count(*) FILTER (WHERE n >= {w}) AS docs_{w}, coalesce(sum(n) FILTER (WHERE n >= {w}), 0) AS tokens_{w}" for w in (256, 512, 1024)) + " FROM d",
    "unigram_entropy": f"{_D}, {_CH}, k AS (SELECT c, count(*) AS k FROM c GROUP BY 1), p AS (SELECT k, k / sum(k) OVER () AS p FROM k), h AS (SELECT sum(k) AS tokens, count(*) AS vocabulary, -sum(p * ln(p)) AS h FROM p) SELECT tokens, vocabulary, round(h, 6) AS entropy, round(exp(h), 4) AS perplexity FROM h",
    "char_vocabulary": f"{_D}, {_CH}, {_V} SELECT char, id FROM v WHERE id <= 60003",
    "char_round_trip": f"{_D} SELECT doc_id, md5(text) AS digest FROM d",
    "fitted_ids": f"{_D} SELECT doc_id, CAST(256 AS INTEGER) AS n, CAST(CASE WHEN n + 2 >= 256 THEN 2 ELSE 0 END AS INTEGER) AS last, CAST(greatest(0, 256 - n - 2) AS INTEGER) AS padding FROM d",
    "token_starts": f"{_D} SELECT doc_id, n + 2 AS n, coalesce(sum(n + 2) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d",
    "position_lookup": f"{_D}, s AS (SELECT doc_id, n + 2 AS n, coalesce(sum(n + 2) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d), p AS (SELECT unnest(generate_series(0, (SELECT max(start + n) - 1 FROM s)::BIGINT, 1000)) AS position) SELECT position, doc_id FROM p JOIN s ON position >= start AND position < start + n",
    "shard_fill": f"""{_D.replace("WITH", "WITH RECURSIVE")}, s AS (SELECT doc_id, n, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 200000 AS g FROM d), o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id) AS i FROM s),
        r AS (SELECT g, i, n AS used, 0 AS shard, n FROM o WHERE i = 1 UNION ALL SELECT o.g, o.i, CASE WHEN r.used > 0 AND r.used + o.n > 20000 THEN o.n ELSE r.used + o.n END, CASE WHEN r.used > 0 AND r.used + o.n > 20000 THEN r.shard + 1 ELSE r.shard END, o.n FROM r JOIN o ON o.g = r.g AND o.i = r.i + 1)
        SELECT CAST(g AS BIGINT) AS "group", shard, count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens FROM r GROUP BY 1, 2""",
    "target_masks": f"{_D} SELECT doc_id, greatest(n - 1, 0) + 1 AS inside FROM d",
    "synthetic_math": """
        WITH r AS (SELECT CAST(range AS INTEGER) AS o FROM range(2400)), a AS (SELECT *, o + 20 AS a, o * 11 % greatest(2, (o + 20) // 2) + 1 AS b, o * 7 % 30 + 1 AS c FROM r)
        SELECT 'add_subtract' AS family, CAST(o AS BIGINT) AS number, ['小明', '小华', '小雨', '小林', '小陈', '小周'][o % 6 + 1] || '有' || a || '个' || ['苹果', '铅笔', '练习本', '糖果', '卡片', '玻璃球'][o % 6 + 1] || '，送出' || b || '个，又得到' || c || '个，现在有多少个？只回答数字。' AS question, CAST(a - b + c AS VARCHAR) AS answer FROM a
        UNION ALL SELECT 'multiply_divide', o + 2400, CASE WHEN o % 2 = 0 THEN '每盒有' || (o // 25 + 2) || '支铅笔，' || (o % 25 + 2) || '盒一共有多少支？只回答数字。' ELSE '把' || ((o // 25 + 2) * (o % 25 + 2)) || '颗糖平均分给' || (o % 25 + 2) || '人，每人分到多少颗？只回答数字。' END, CASE WHEN o % 2 = 0 THEN CAST((o // 25 + 2) * (o % 25 + 2) AS VARCHAR) ELSE CAST(o // 25 + 2 AS VARCHAR) END FROM r WHERE o < 2000
        UNION ALL SELECT 'percentage', o + 4400, ((o // 10 + 1) * 20) || '的' || [5, 10, 15, 20, 25, 30, 40, 50, 60, 75][o % 10 + 1] || '%是多少？只回答数字。', CAST((o // 10 + 1) * 20 * [5, 10, 15, 20, 25, 30, 40, 50, 60, 75][o % 10 + 1] // 100 AS VARCHAR) FROM r WHERE o < 1200
        UNION ALL SELECT 'time_conversion', o + 5600, (o // 60 + 1) || '小时' || (o % 60) || '分钟一共是多少分钟？只回答数字。', CAST((o // 60 + 1) * 60 + o % 60 AS VARCHAR) FROM r WHERE o < 1200
        UNION ALL SELECT 'mixed_arithmetic', o + 6800, ((o + 2) * 6) || '除以6，再加上' || (o * 7 % 25 + 1) || '，结果是多少？请给出简短计算过程。', ((o + 2) * 6) || '÷6+' || (o * 7 % 25 + 1) || '=' || (o + 2 + o * 7 % 25 + 1) || '。答案：' || (o + 2 + o * 7 % 25 + 1) || '。' FROM r WHERE o < 1200""",
    "language_model_windows": f"{_D}, w AS (SELECT doc_id, n + 2 AS n, CASE WHEN n + 2 <= 129 THEN 1 ELSE CAST(ceil((n + 2 - 129) / 96.0) AS INTEGER) + 1 END AS windows FROM d) SELECT doc_id, windows, CAST(greatest(0, (windows - 1) * 96 + 129 - n) AS INTEGER) AS ignored FROM w",
    "boundary_profile": f"{_D}, s AS (SELECT coalesce(sum(n + 2) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, n + 2 AS n FROM d), t AS (SELECT CAST(greatest((max(s + n) - 513) // 512 + 1, 0) AS BIGINT) AS w FROM s), h AS (SELECT k FROM s, t, range(0, w) r(k) WHERE s.s > k * 512 AND s.s < k * 512 + 513) SELECT w AS windows, w * 512 AS targets, (SELECT count(DISTINCT k) FROM h) AS crossing_windows, (SELECT count(*) FROM h) AS crossing_targets FROM t",
    "synthetic_json": """SELECT i AS id, '{"name":"item-' || i || '","amount":' || (i * 17 % 101) || '}' AS answer, 'Give item-' || i || ' with amount ' || (i * 17 % 101) || ' as JSON.' AS question FROM range(1000) t(i)""",
    "loss_acceptance": f"WITH {_E}, r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS a, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS b FROM e), g AS (SELECT event_type, avg(value) FILTER (WHERE a <= 10) AS f, avg(value) FILTER (WHERE b <= 10) AS l FROM r GROUP BY 1) SELECT event_type, round(f, 6) AS first_mean, round(l, 6) AS last_mean, round(f - l, 6) AS drop, l < f AS accepted FROM g",
    "loss_guard": f"WITH {_E}, r AS (SELECT *, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS rn, avg(value) OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS recent FROM e), b AS (SELECT *, avg(CASE WHEN rn <= 10 THEN value END) OVER (PARTITION BY event_type, day) AS base FROM r) SELECT event_type, count(*) AS alarms FROM b WHERE rn >= 20 AND recent > 1.5 * base GROUP BY 1",
    "text_metrics_bits": f"{_D}, {_CH}, k AS (SELECT lang, c, count(*) AS n FROM c WHERE lang IS NOT NULL GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY lang) AS t FROM k) SELECT lang, sum(n) AS chars, round(-sum(n * log2(n / t)) / sum(n), 6) AS bits_per_char, round(-sum(n * log2(n / t)) / sum(n * octet_length(encode(c))), 6) AS bits_per_byte FROM t GROUP BY 1",
    "decision_asof": "WITH q AS (SELECT decision_id, pair_id, decided_at, accepted FROM quality_decisions WHERE decided_at IS NOT NULL AND pair_id IS NOT NULL), r AS (SELECT pair_id, decided_at AS rt, max(accepted::INT) AS a FROM q GROUP BY 1, 2), j AS (SELECT q.decision_id, (SELECT arg_max(a, rt) FROM r WHERE r.pair_id = q.pair_id AND r.rt < q.decided_at) AS a FROM q) SELECT a = 1 AS before, count(*) AS decisions FROM j GROUP BY 1",
    "event_windows": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
QUERIES = (
    window_starts, interval_union_coverage, doc_coverage, unigram_entropy, char_vocabulary, char_encoding, char_round_trip, fitted_ids, token_starts, position_lookup, shard_fill, pack_windows, target_masks, language_model_windows, boundary_profile, synthetic_math, synthetic_json, loss_acceptance, loss_guard,
    text_metrics_bits, decision_asof, event_windows,
)
