"""Curation of documents and records: quotas, samples, splits, strata, conversations; its queries and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import ranking
from ..session import table

SEED = 20260809
# Role names, and the marks of chat templates.
ROLES = {"human": "user", "prompter": "user", "usr": "user", "user": "user", "assistant": "assistant", "gpt": "assistant", "bot": "assistant", "sys": "assistant", "system": "system"}
DEFAULT_SYSTEM = "You are a helpful assistant."


def parse_chat(text: Column | str) -> Column:
    """Messages of a text in labelled form: an array of (role, content); empty without labels."""
    parts = F.regexp_extract_all(tx.col(text), F.lit(r"(?s)<\|im_start\|>\w+\n.*?(?=<\|im_end\|>|<\|im_start\|>|\z)"), F.lit(0))
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^<\|im_start\|>(\w+)", 1).alias("role"), F.regexp_replace(p, r"^<\|im_start\|>\w+\n", "").alias("content")))


def normalize_messages(messages: Column) -> Column:
    """Roles by their aliases, contents normalised; messages of unknown roles or without content go."""
    alias = F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))
    plain = F.transform(messages, lambda m: F.struct(alias[F.lower(F.trim(m["role"]))].alias("role"), tx.chat_text(m["content"]).alias("content")))
    return F.filter(plain, lambda m: m["role"].isNotNull() & (m["content"] != ""))


def structural_reason(messages: Column, least: int = 12, most: int = 12_000) -> Column:
    """The first structural fault of a conversation; null if it has none."""

    def judge(ms: Column) -> Column:
        said = F.filter(ms, lambda m: m["role"] != "system")
        turns = F.zip_with(F.slice(said, 1, F.greatest(F.size(said) - 1, F.lit(0))), F.slice(said, 2, F.greatest(F.size(said) - 1, F.lit(0))), lambda a, b: a["role"] == b["role"])
        return (
            F.when(F.size(ms) < 2, "too_few_messages")
            .when(F.element_at(ms, -1)["role"] != "assistant", "does_not_end_assistant")
            .when((F.size(said) == 0) | (F.try_element_at(said, F.lit(1))["role"] != "user"), "does_not_start_user")
            .when(F.exists(turns, lambda x: x), "roles_not_alternating")
            .when(F.aggregate(ms, F.lit(0), lambda acc, m: acc + F.length(m["content"])) < least, "too_short")
            .when(F.exists(ms, lambda m: F.length(m["content"]) > most), "single_message_too_long")
        )

    return tx.let(messages, judge)


def content_key(messages: Column) -> Column:
    """Digest of the canonical JSON: keys in order, no blanks."""
    return F.sha2(F.to_json(F.transform(messages, lambda m: F.struct(m["content"].alias("content"), m["role"].alias("role")))), 256)


def chatml(messages: Column, system: str = DEFAULT_SYSTEM) -> Column:
    """The conversation in labelled form; a default system message leads where there is none."""
    one = lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>"))
    body = F.array_join(F.transform(messages, one), "\n")
    lead = F.lit(f"<|im_start|>system\n{system}<|im_end|>\n")
    return F.when(F.try_element_at(messages, F.lit(1))["role"] == "system", body).otherwise(F.concat(lead, body))


def label_mask(messages: Column, system: str = DEFAULT_SYSTEM) -> Column:
    """0 and 1 for each character of ``chatml``: 1 in what the assistant says and its closing label."""

    def one(m: Column) -> Column:
        head = F.length(F.lit("<|im_start|>")) + F.length(m["role"]) + 1
        tail = F.length(m["content"]) + F.length(F.lit("<|im_end|>"))
        return F.concat(F.repeat(F.lit("0"), head), F.repeat(F.when(m["role"] == "assistant", "1").otherwise("0"), tail))

    body = F.array_join(F.transform(messages, one), "0")
    lead = "0" * len(f"<|im_start|>system\n{system}<|im_end|>\n")
    return F.when(F.try_element_at(messages, F.lit(1))["role"] == "system", body).otherwise(F.concat(F.lit(lead), body))


def windows(messages: Column, most: int = 12, stride: int = 8) -> Column:
    """Windows of a long conversation as (start, messages), each trimmed to begin with user and end with assistant."""

    def cut(ms: Column) -> Column:
        n = F.size(ms)
        last = F.greatest(F.ceil((n - most) / stride), F.lit(0)).cast("int")

        def one(i: Column) -> Column:
            own = F.slice(ms, i * stride + 1, most)
            roles = F.transform(own, lambda m: m["role"])
            a = F.array_position(roles, "user").cast("int")
            b = (F.size(roles) + 1 - F.array_position(F.reverse(roles), "assistant")).cast("int")
            ok = (a > 0) & F.array_contains(roles, "assistant") & (b > a)
            return F.struct((i * stride).alias("start"), F.when(ok, F.slice(own, a, F.greatest(b - a + 1, F.lit(0)))).alias("messages"))

        found = F.filter(F.transform(F.sequence(F.lit(0), last), one), lambda w: F.size(w["messages"]) >= 2)
        whole = F.when(F.element_at(ms, -1)["role"] == "assistant", F.array(F.struct(F.lit(0).alias("start"), ms.alias("messages")))).otherwise(F.slice(found, 1, 0))
        return F.when(n == 0, F.slice(found, 1, 0)).when(n <= most, whole).otherwise(found)

    return tx.let(messages, cut)


# --- queries -----------------------------------------------------------------------------------------


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null")


def _chats(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).filter(F.contains("text", F.lit("<|im_start|>"))).select("doc_id", "source", "category", normalize_messages(parse_chat("text")).alias("messages")).filter("size(messages) > 0")


def conversation_reasons(spark, d):
    return _chats(spark, d).groupBy(F.coalesce(structural_reason(F.col("messages")), F.lit("accepted")).alias("reason")).agg(F.count("*").alias("conversations"), F.sum(F.size("messages")).alias("messages"))


def conversation_forms(spark, d):
    """Templates, masks and keys of each conversation."""
    own = _chats(spark, d).select("doc_id", "messages", chatml(F.col("messages")).alias("t"), label_mask(F.col("messages")).alias("m"))
    return own.select("doc_id", content_key(F.col("messages")).alias("content_key"), F.length("t").alias("chars"), F.regexp_count("m", F.lit("1")).alias("labelled"), (F.length("t") == F.length("m")).alias("aligned"), F.md5("t").alias("digest"))


def conversation_windows(spark, d):
    return _chats(spark, d).select("doc_id", F.explode(windows(F.col("messages"), 4, 2)).alias("w")).select("doc_id", "w.start", F.size("w.messages").alias("messages"), content_key(F.col("w.messages")).alias("content_key"))


def conversation_dedup(spark, d):
    """Conversations of a source with equal contents once, those of all sources once."""
    own = _chats(spark, d).select("doc_id", F.coalesce("source", F.lit("unknown")).alias("source"), content_key(F.col("messages")).alias("k"))
    return own.groupBy("source").agg(F.count("*").alias("conversations"), F.count_distinct("k").alias("distinct_contents"))


def hash_topk_per_source(spark, d):
    h = ranking.hash_score(SEED, F.col("source"), F.col("doc_id"))
    own = _docs(spark, d).filter("source is not null").select("doc_id", "source", h.alias("score"))
    return ranking.top_per_group(own, ["source"], [F.col("score")], 5)


def category_caps(spark, d):
    own = _docs(spark, d).filter("category is not null").select("doc_id", "category", F.coalesce(F.col("score"), F.lit(-1.0)).alias("s"), ranking.hash_score(SEED, F.col("doc_id")).alias("h"))
    return ranking.capped(own, "category", {"news": 20, "legal": 10}, 60, [(F.col("s") >= 4).desc(), F.col("h")]).select("doc_id", "category")


def deterministic_shuffle_rank(spark, d):
    own = _docs(spark, d).select("doc_id", ranking.hash_score(SEED, F.col("doc_id")).alias("h"))
    return ranking.global_rank(own, ["h", "doc_id"]).select("doc_id", "rank")


def hamilton_quota(spark, d):
    n = _docs(spark, d).filter("category is not null").groupBy("category").agg(F.count("*").alias("docs"))
    return ranking.hamilton_quotas(n, "category", "docs", F.lit(100))


def hamilton_sample(spark, d):
    """As many documents of each category as its quota, in hash order."""
    own = _docs(spark, d).filter("category is not null").select("doc_id", "category", ranking.hash_score(SEED, F.col("doc_id")).alias("h"))
    quota = ranking.hamilton_quotas(own.groupBy("category").agg(F.count("*").alias("docs")), "category", "docs", F.lit(100)).select("category", "quota")
    return ranking.top_per_group(own.join(quota, "category"), ["category"], [F.col("h"), F.col("doc_id")], F.col("quota"), 100).select("doc_id", "category")


def even_sample(spark, d):
    """Nine documents at even places of the order by id, both ends kept."""
    own = _docs(spark, d).select("doc_id")
    return ranking.pick_places(own, ["doc_id"], ranking.even_places(own.count(), 9)).select("doc_id")


def evenly_spaced(spark, d):
    own = table(spark, d, "text_records").select("source_file").filter("source_file is not null").distinct()
    return ranking.pick_places(own, ["source_file"], ranking.spaced_places(own.count(), 3)).select("source_file")


def exact_sample(spark, d):
    """Fifty rows by line numbers that Python's generator draws from the row count alone."""
    own = _docs(spark, d).select("doc_id")
    return ranking.pick_places(own, ["doc_id"], ranking.exact_sample_places(own.count(), 50, SEED)).select("doc_id")


def group_split_mod(spark, d):
    own = _docs(spark, d).select("doc_id", ranking.split_mod(F.concat_ws(":", F.coalesce("source", F.lit("unknown")), (F.col("doc_id") % 97).cast("string")), 0.1).alias("split"))
    return own


def source_split(spark, d):
    own = table(spark, d, "pair_records").filter("source is not null and target is not null").select("pair_id", "source")
    return ranking.split_by_source(own, "source", "pair_id", 0.1, SEED).select("pair_id", "split")


def split_overlap_audit(spark, d):
    """Sources and pairs that stand in train and in another split."""
    own = table(spark, d, "pair_records").filter("source is not null and target is not null").select((F.lower(F.trim("split")) == "train").alias("train"), F.md5("source").alias("s"), F.md5(F.concat("source", F.lit("\1"), "target")).alias("p"))
    both = lambda k: own.groupBy(k).agg(F.bool_or("train").alias("a"), F.bool_or(~F.col("train")).alias("b")).filter("a and b").agg(F.count("*").alias("n"))
    return both("s").select(F.lit("source").alias("key"), "n").unionByName(both("p").select(F.lit("pair").alias("key"), "n"))


def stratified_anchors(spark, d):
    """Sixty documents by strata with fixed shares, what a stratum lacks filled from the others."""
    stratum = F.when(F.col("category").isin("legal", "academic"), "specialist").when(F.col("category").isin("news", "formal"), "general").when(F.col("category") == "spoken", "plain")
    own = _docs(spark, d).select("doc_id", "category")
    got = ranking.stratified_anchors(own, stratum, {"specialist": 0.5, "general": 0.3, "plain": 0.2}, 60, "doc_id", SEED)
    return got.select("doc_id", "stratum")


def record_summary(spark, d):
    """Documents by source: counts, characters and nearest-rank percentiles (place = floor of n x share)."""
    own = _docs(spark, d).filter("source is not null").select("source", F.length("text").alias("n"))
    counts = own.groupBy("source", "n").agg(F.count("*").alias("c"))  # a row for each length, however many texts have it
    w = Window.partitionBy("source")
    ranked = counts.withColumn("upto", F.sum("c").over(w.orderBy("n"))).withColumn("k", F.sum("c").over(w))
    at = lambda q: F.min(F.when(F.col("upto") > F.least(F.col("k") - 1, F.floor(F.col("k") * q)), F.col("n")))
    return ranked.groupBy("source").agg(F.sum("c").alias("docs"), F.sum(F.col("n") * F.col("c")).alias("chars"), F.min("n").alias("shortest"), F.max("n").alias("longest"), F.round(F.sum(F.col("n") * F.col("c")) / F.sum("c"), 6).alias("mean_chars"), at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.95).alias("p95"))


# Scenarios, the sources that belong to each whole, and terms of categories that do.
SCENARIOS = (
    ("conversation", ("smoltalk_chinese", "duconv", "kdconv", "crosswoz", "oasst2_zh"), ("everyday", "task_oriented", "knowledge_dialogue", "human_feedback_dialogue")),
    ("knowledge_qa", ("coig_cqia",), ("knowledge", "information-seeking", "问答", "概念解析", "百科")),
    ("reading_comprehension", ("cmrc2018", "drcd", "dolly_closed_qa"), ("reading_comprehension", "document-qa", "understanding", "english_closed_qa")),
    ("writing_revision", ("doit_creative_writing", "dolly_creative_writing", "dolly_brainstorming"), ("writing", "editing", "rewrite", "brainstorming", "写", "纠错", "扩写", "对联")),
    ("summarization_translation", (), ("summary", "summarization", "摘要", "translate", "翻译", "简繁", "繁体")),
    ("math", ("gsm8k_zh", "synthetic_math_verified"), ("arithmetic", "add_subtract", "multiply_divide", "percentage", "数学")),
    ("programming", ("coig_leetcode", "doit_code"), ("code", "代码", "SQL")),
    ("reasoning", ("doit_reasoning",), ("reasoning", "推理", "因果分析", "判断")),
    ("nlp_structured_output", ("synthetic_instruction_verified", "dolly_classification", "dolly_information_extraction"), ("classification", "information_extraction", "分类", "抽取", "json", "fixed_list", "key_value", "table")),
    ("strict_instruction_following", ("synthetic_instruction_verified", "tulu_instruction_following"), ("strict_instruction_following",)),
    ("planning_advice", (), ("planning", "advice-seeking", "wikihow")),
    ("safety_values", ("coig_human_value", "synthetic_safety_verified"), ("safe", "privacy", "safety", "credentials", "phishing", "fraud", "human_value")),
    ("identity", ("synthetic_identity_verified",), ("identity_", "capability_boundary", "experience_boundary")),
    ("creative_roleplay", ("doit_creative_writing", "doit_role_play"), ("creative_writing", "role_play", "故事", "诗词")),
    ("factual_correction", ("coig_counterfactual",), ("factual_correction",)),
    ("humanities_chinese", ("doit_chinese", "doit_history"), ("古诗", "文言", "作者介绍", "历史")),
)


def scenarios(records: DataFrame) -> DataFrame:
    """(scenario, records, share): overlapping scenarios by source and category, and ``any`` for records of at least one.

    Null sources and categories are ``unknown``. Rules are judged once for each source and category.
    """
    own = records.groupBy(F.coalesce("source", F.lit("unknown")).alias("source"), F.coalesce("category", F.lit("unknown")).alias("category")).agg(F.count("*").alias("n"))
    hit = lambda sources, terms: F.col("source").isin(*sources) | F.regexp_like("category", F.lit("|".join(terms)))
    found = [hit(s, t) for _, s, t in SCENARIOS]
    some = F.lit(False)
    for h in found:
        some = some | h
    keys = [*(k for k, _, _ in SCENARIOS), "any"]
    counts = own.agg(F.sum("n").alias("total"), *(F.coalesce(F.sum(F.when(h, F.col("n"))), F.lit(0)).alias(k) for k, h in zip(keys, [*found, some])))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(k).alias("scenario"), F.col(k).alias("records"), F.round(tx.ratio(F.col(k), F.col("total")), 6).alias("share")) for k in keys))).alias("x")).select("x.*")


def scenario_coverage(spark, d):
    """Documents and pairs by scenario, with names of public sets and abilities among their sources and categories."""
    docs = table(spark, d, "documents").select("source", "category")
    names = F.array(*(F.lit(x) for x in ("coig_cqia", "gsm8k_zh", "doit_code", "drcd", "kdconv", "tulu_instruction_following", "other", "dolly_brainstorming", "coig_human_value", "doit_history")))
    kinds = F.array(*(F.lit(x) for x in ("writing", "code_x", "knowledge_dialogue", "identity_y", "摘要", "table", "role_play")))
    pairs = table(spark, d, "pair_records").select(F.get(names, F.pmod("pair_id", F.lit(10)).cast("int")).alias("source"), F.get(kinds, F.pmod("pair_id", F.lit(7)).cast("int")).alias("category"))
    return scenarios(docs.unionByName(pairs))


def script_profile(spark, d):
    """Distinct characters by script, and how often they stand in texts."""
    chars = _docs(spark, d).select(F.explode(F.split("text", "")).alias("c")).filter("c <> ''").groupBy("c").agg(F.count("*").alias("n"))
    kind = F.when(F.regexp_like("c", F.lit(tx.HAN)), "han").when(F.regexp_like("c", F.lit("[A-Za-z]")), "latin").when(F.regexp_like("c", F.lit(r"\p{Nd}")), "digit").when(F.regexp_like("c", F.lit(r"\p{P}")), "punctuation").otherwise("other")
    return chars.groupBy(kind.alias("script")).agg(F.count("*").alias("alphabet"), F.sum("n").alias("chars"))


def union_base_additions(spark, d):
    """Base rows and additions that the base doesn't hold by content."""
    own = _docs(spark, d).select("doc_id", "category", F.md5("text").alias("k"))
    base, new = own.filter("category in ('news', 'formal')"), own.filter("category in ('legal', 'academic')")
    return base.unionByName(new.join(base.select("k"), "k", "left_anti").select(*base.columns)).groupBy("category").agg(F.count("*").alias("rows"), F.count_distinct("k").alias("contents"))


_H = f"sha256('{SEED}' || ':' || {{0}})"
_D = "WITH d AS (SELECT * FROM documents WHERE text IS NOT NULL)"
_MESSAGE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace({0}, '\r\n?', chr(10), 'g'), chr(0), ''), '[ \t]+', ' ', 'g'), '(?m)^[ \x{{a0}}\x{{3000}}]+|[ \x{{a0}}\x{{3000}}]+$', '', 'g'), '([\x{{3400}}-\x{{9fff}}]) +([\x{{3400}}-\x{{9fff}}])', '\1\2', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_CONVERSATIONS = f"""
        WITH p AS (SELECT doc_id, source, list_filter(string_split(text, '<|im_start|>')[2:], lambda x: regexp_matches(x, '^[0-9A-Za-z_]+\\n')) AS p FROM documents WHERE contains(text, '<|im_start|>')),
        a AS (SELECT *, list_transform(p, lambda x: {{'r': CASE lower(regexp_extract(x, '^([0-9A-Za-z_]+)\\n', 1)) WHEN 'human' THEN 'user' WHEN 'prompter' THEN 'user' WHEN 'usr' THEN 'user' WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'assistant' WHEN 'gpt' THEN 'assistant' WHEN 'bot' THEN 'assistant' WHEN 'sys' THEN 'assistant' WHEN 'system' THEN 'system' END,
            'c': {_MESSAGE.format("string_split(regexp_replace(x, '^[0-9A-Za-z_]+" + chr(92) + "n', ''), '<|im_end|>')[1]")}}}) AS m FROM p),
        k AS (SELECT doc_id, source, list_filter(m, lambda x: x.r IS NOT NULL AND x.c <> '') AS m FROM a WHERE len(list_filter(m, lambda x: x.r IS NOT NULL AND x.c <> '')) > 0)"""
SQL = {
    "conversation_reasons": _CONVERSATIONS + """
        SELECT CASE WHEN len(m) < 2 THEN 'too_few_messages' WHEN m[-1].r <> 'assistant' THEN 'does_not_end_assistant' WHEN coalesce(s[1], '') <> 'user' THEN 'does_not_start_user' WHEN len(list_filter(range(2, len(s) + 1), lambda i: s[i] = s[i - 1])) > 0 THEN 'roles_not_alternating'
            WHEN n < 12 THEN 'too_short' WHEN w > 12000 THEN 'single_message_too_long' ELSE 'accepted' END AS reason, count(*) AS conversations, CAST(sum(len(m)) AS BIGINT) AS messages
        FROM (SELECT *, list_filter(list_transform(m, lambda x: x.r), lambda r: r <> 'system') AS s, list_sum(list_transform(m, lambda x: length(x.c))) AS n, list_max(list_transform(m, lambda x: length(x.c))) AS w FROM k) GROUP BY 1""",
    "conversation_dedup": _CONVERSATIONS + " SELECT coalesce(source, 'unknown') AS source, count(*) AS conversations, count(DISTINCT m) AS distinct_contents FROM k GROUP BY 1",
    "hash_topk_per_source": f"{_D} SELECT doc_id, source, score FROM (SELECT doc_id, source, {_H.format(chr(115) + 'ource || ' + repr(':') + ' || doc_id')} AS score, row_number() OVER (PARTITION BY source ORDER BY {_H.format('source || ' + repr(':') + ' || doc_id')}) AS rn FROM d WHERE source IS NOT NULL) WHERE rn <= 5",
    "category_caps": f"{_D}, o AS (SELECT doc_id, category, coalesce(score, -1) >= 4 AS good, {_H.format('doc_id')} AS h FROM d WHERE category IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY good DESC, h) AS rn FROM o), c AS (SELECT * FROM r WHERE rn <= CASE category WHEN 'news' THEN 20 WHEN 'legal' THEN 10 ELSE 60 END) SELECT doc_id, category FROM c ORDER BY good DESC, h LIMIT 60",
    "deterministic_shuffle_rank": f"{_D} SELECT doc_id, row_number() OVER (ORDER BY {_H.format('doc_id')}, doc_id) - 1 AS rank FROM d",
    "hamilton_quota": f"{_D}, n AS (SELECT category, count(*) AS docs FROM d WHERE category IS NOT NULL GROUP BY 1), x AS (SELECT *, 100.0::DOUBLE * docs / sum(docs) OVER () AS x FROM n), r AS (SELECT *, floor(x) AS f, row_number() OVER (ORDER BY x - floor(x) DESC, docs DESC, category) AS rn FROM x) SELECT category, docs, CAST(f + CASE WHEN rn <= 100 - sum(f) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM r",
    "hamilton_sample": f"{_D}, n AS (SELECT category, count(*) AS docs FROM d WHERE category IS NOT NULL GROUP BY 1), x AS (SELECT *, 100.0::DOUBLE * docs / sum(docs) OVER () AS x FROM n), r AS (SELECT *, floor(x) AS f, row_number() OVER (ORDER BY x - floor(x) DESC, docs DESC, category) AS rn FROM x), q AS (SELECT category, f + CASE WHEN rn <= 100 - sum(f) OVER () THEN 1 ELSE 0 END AS quota FROM r), s AS (SELECT doc_id, category, row_number() OVER (PARTITION BY category ORDER BY {_H.format('doc_id')}, doc_id) AS rn FROM d WHERE category IS NOT NULL) SELECT doc_id, s.category FROM s JOIN q USING (category) WHERE rn <= quota",
    "even_sample": f"{_D}, r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rn, count(*) OVER () AS n FROM d) SELECT DISTINCT doc_id FROM r, generate_series(0, 8) g(i) WHERE rn = round_even(i * (n - 1) / 8.0, 0)",
    "evenly_spaced": "WITH f AS (SELECT DISTINCT source_file FROM text_records WHERE source_file IS NOT NULL), r AS (SELECT source_file, row_number() OVER (ORDER BY source_file) - 1 AS rn, count(*) OVER () AS n FROM f) SELECT DISTINCT source_file FROM r, generate_series(0, 2) g(i) WHERE rn = least(n - 1, floor((i + 0.5) * n / 3))",
    "group_split_mod": f"{_D} SELECT doc_id, CASE WHEN CAST('0x' || substr(sha256(coalesce(source, 'unknown') || ':' || (doc_id % 97)), 1, 16) AS UBIGINT) % 1000000 < 100000 THEN 'validation' ELSE 'train' END AS split FROM d",
    "source_split": f"WITH p AS (SELECT pair_id, source FROM pair_records WHERE source IS NOT NULL AND target IS NOT NULL) SELECT pair_id, CASE WHEN substr(sha256('{SEED}' || chr(0) || source), 1, 16) < '{int(0.1 * (1 << 64)):016x}' THEN 'validation' ELSE 'train' END AS split FROM p",
    "split_overlap_audit": "WITH p AS (SELECT lower(trim(split)) = 'train' AS train, source, target FROM pair_records WHERE source IS NOT NULL AND target IS NOT NULL) SELECT 'source' AS key, (SELECT count(*) FROM (SELECT source FROM p GROUP BY 1 HAVING bool_or(train) AND bool_or(NOT train))) AS n UNION ALL SELECT 'pair', (SELECT count(*) FROM (SELECT source, target FROM p GROUP BY 1, 2 HAVING bool_or(train) AND bool_or(NOT train)))",
    "record_summary": f"{_D}, o AS (SELECT source, length(text) AS n FROM d WHERE source IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n) - 1 AS r, count(*) OVER (PARTITION BY source) AS k FROM o) SELECT source, count(*) AS docs, sum(n) AS chars, min(n) AS shortest, max(n) AS longest, round(avg(n), 6) AS mean_chars, "
    + ", ".join(f"max(CASE WHEN r = least(k - 1, floor(k * {q})) THEN n END) AS {a}" for q, a in ((0.5, "p50"), (0.9, "p90"), (0.95, "p95"))) + " FROM r GROUP BY source",
    "scenario_coverage": """
        WITH r AS (SELECT coalesce(source, 'unknown') AS source, coalesce(category, 'unknown') AS category FROM documents UNION ALL
            SELECT ['coig_cqia', 'gsm8k_zh', 'doit_code', 'drcd', 'kdconv', 'tulu_instruction_following', 'other', 'dolly_brainstorming', 'coig_human_value', 'doit_history'][pair_id % 10 + 1], ['writing', 'code_x', 'knowledge_dialogue', 'identity_y', '摘要', 'table', 'role_play'][pair_id % 7 + 1] FROM pair_records),
        h AS (SELECT [
            {'k': 'conversation', 'h': source IN ('smoltalk_chinese', 'duconv', 'kdconv', 'crosswoz', 'oasst2_zh') OR regexp_matches(category, 'everyday|task_oriented|knowledge_dialogue|human_feedback_dialogue')},
            {'k': 'knowledge_qa', 'h': source IN ('coig_cqia') OR regexp_matches(category, 'knowledge|information-seeking|问答|概念解析|百科')},
            {'k': 'reading_comprehension', 'h': source IN ('cmrc2018', 'drcd', 'dolly_closed_qa') OR regexp_matches(category, 'reading_comprehension|document-qa|understanding|english_closed_qa')},
            {'k': 'writing_revision', 'h': source IN ('doit_creative_writing', 'dolly_creative_writing', 'dolly_brainstorming') OR regexp_matches(category, 'writing|editing|rewrite|brainstorming|写|纠错|扩写|对联')},
            {'k': 'summarization_translation', 'h': source IN ('') OR regexp_matches(category, 'summary|summarization|摘要|translate|翻译|简繁|繁体')},
            {'k': 'math', 'h': source IN ('gsm8k_zh', 'synthetic_math_verified') OR regexp_matches(category, 'arithmetic|add_subtract|multiply_divide|percentage|数学')},
            {'k': 'programming', 'h': source IN ('coig_leetcode', 'doit_code') OR regexp_matches(category, 'code|代码|SQL')},
            {'k': 'reasoning', 'h': source IN ('doit_reasoning') OR regexp_matches(category, 'reasoning|推理|因果分析|判断')},
            {'k': 'nlp_structured_output', 'h': source IN ('synthetic_instruction_verified', 'dolly_classification', 'dolly_information_extraction') OR regexp_matches(category, 'classification|information_extraction|分类|抽取|json|fixed_list|key_value|table')},
            {'k': 'strict_instruction_following', 'h': source IN ('synthetic_instruction_verified', 'tulu_instruction_following') OR regexp_matches(category, 'strict_instruction_following')},
            {'k': 'planning_advice', 'h': source IN ('') OR regexp_matches(category, 'planning|advice-seeking|wikihow')},
            {'k': 'safety_values', 'h': source IN ('coig_human_value', 'synthetic_safety_verified') OR regexp_matches(category, 'safe|privacy|safety|credentials|phishing|fraud|human_value')},
            {'k': 'identity', 'h': source IN ('synthetic_identity_verified') OR regexp_matches(category, 'identity_|capability_boundary|experience_boundary')},
            {'k': 'creative_roleplay', 'h': source IN ('doit_creative_writing', 'doit_role_play') OR regexp_matches(category, 'creative_writing|role_play|故事|诗词')},
            {'k': 'factual_correction', 'h': source IN ('coig_counterfactual') OR regexp_matches(category, 'factual_correction')},
            {'k': 'humanities_chinese', 'h': source IN ('doit_chinese', 'doit_history') OR regexp_matches(category, '古诗|文言|作者介绍|历史')}] AS h FROM r),
        u AS (SELECT unnest(list_append(h, {'k': 'any', 'h': len(list_filter(h, lambda x: x.h)) > 0})) AS x FROM h)
        SELECT x.k AS scenario, count(*) FILTER (WHERE x.h) AS records, round(count(*) FILTER (WHERE x.h) / (SELECT count(*) FROM r), 6) AS share FROM u GROUP BY 1""",
    "script_profile": f"{_D}, c AS (SELECT c, count(*) AS n FROM (SELECT unnest(list_filter(string_split(text, ''), lambda x: x <> '')) AS c FROM d) GROUP BY 1) SELECT CASE WHEN regexp_matches(c, '[\\x{{3400}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{9fff}}\\x{{f900}}-\\x{{faff}}]') THEN 'han' WHEN regexp_matches(c, '[A-Za-z]') THEN 'latin' WHEN regexp_matches(c, '\\p{{Nd}}') THEN 'digit' WHEN regexp_matches(c, '\\p{{P}}') THEN 'punctuation' ELSE 'other' END AS script, count(*) AS alphabet, CAST(sum(n) AS BIGINT) AS chars FROM c GROUP BY 1",
    "union_base_additions": f"{_D}, u AS (SELECT category, text FROM d WHERE category IN ('news', 'formal') UNION ALL SELECT category, text FROM d WHERE category IN ('legal', 'academic') AND text NOT IN (SELECT text FROM d WHERE category IN ('news', 'formal'))) SELECT category, count(*) AS rows, count(DISTINCT text) AS contents FROM u GROUP BY 1",
    "stratified_anchors": f"""{_D}, o AS (SELECT doc_id, CASE WHEN category IN ('legal', 'academic') THEN 'specialist' WHEN category IN ('news', 'formal') THEN 'general' WHEN category = 'spoken' THEN 'plain' END AS stratum FROM d), h AS (SELECT *, sha256('{SEED}:' || stratum || ':' || doc_id) AS h FROM o WHERE stratum IS NOT NULL),
        r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h, doc_id) AS rn FROM h), f AS (SELECT *, CASE WHEN rn <= CASE stratum WHEN 'specialist' THEN 30 WHEN 'general' THEN 18 ELSE 12 END THEN 0 ELSE 1 END AS fill FROM r) SELECT doc_id, stratum FROM f ORDER BY fill, CASE WHEN fill = 1 THEN h END, stratum, h, doc_id LIMIT 60""",
}
SQL = {k: v for k, v in SQL.items() if v}
QUERIES = (
    conversation_reasons, conversation_forms, conversation_windows, conversation_dedup, hash_topk_per_source, category_caps, deterministic_shuffle_rank, hamilton_quota, hamilton_sample, even_sample, evenly_spaced,
    exact_sample, group_split_mod, source_split, split_overlap_audit, stratified_anchors, record_summary, scenario_coverage, script_profile, union_base_additions,
)
