"""Instruction sets and their validation: readers of public sets over files, filters, audits, choices; queries and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import choices, forms
from ..functions import text as tx
from ..operators import ranking, tokens, validation
from ..session import scratch, table
from ..sources import cache, readers, sets, sinks
from .pairs import newest_decisions


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pair_records")


def _written(df: DataFrame, what: str) -> str:
    """The rows as JSON lines in the shared folder, for readers to read."""
    path = scratch(df.sparkSession, what)
    df.write.json(path)
    return path


def _told(ms: str = "messages"):
    return F.md5(F.array_join(F.transform(ms, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n"))


def record_filter(spark, d):
    """Pairs as conversations of one chat set, by the first reason to leave them out."""
    own = _pairs(spark, d).select(sets.plain_messages(F.array(sets.said("user", F.col("source")), sets.said("assistant", F.col("target")))).alias("m"))
    size = F.aggregate("m", F.lit(0), lambda a, m: a + F.length(m["content"]))
    answer = F.aggregate(F.filter("m", lambda m: m["role"] == "assistant"), F.lit(0), lambda a, m: a + F.length(m["content"]))
    reason = validation.filter_reason(F.col("m"), F.lit("smoltalk_chinese"), F.lit("everyday"), size, answer, most_tokens=512)
    return own.groupBy(F.coalesce(reason, F.lit("accepted")).alias("reason")).agg(F.count("*").alias("pairs"))


def target_issues(spark, d):
    """What each target changed of its source and mustn't."""
    own = _pairs(spark, d).filter("source is not null and target is not null")
    return own.groupBy(F.coalesce(validation.target_issue(F.col("source"), F.col("target")), F.lit("kept")).alias("issue")).agg(F.count("*").alias("pairs"))


def output_issue_report(spark, d):
    """Newest decisions as delivered outputs of the pairs: errors by code."""
    inputs = _pairs(spark, d).select(F.col("pair_id").alias("place"), F.col("pair_id").cast("string").alias("key"), "source")
    new = newest_decisions(table(spark, d, "quality_decisions"))
    outputs = new.select(F.col("pair_id").alias("place"), F.col("pair_id").cast("string").alias("key"), F.when(F.col("accepted"), "simplified").when(~F.col("accepted"), "keep").alias("decision"), F.col("candidate").alias("target"))
    return validation.output_issues(inputs, outputs).groupBy("code").agg(F.count("*").alias("issues"))


def surface_revert_report(spark, d):
    """Targets that differ from their source in marks and blanks alone are taken back."""
    own = _pairs(spark, d).filter("source is not null and target is not null").select("source", "target", F.lit("simplified").alias("decision"))
    return validation.surface_reverts(own, fold=False).groupBy("decision").agg(F.count("*").alias("pairs"), F.count_if("reverted").alias("reverted"), F.sum(F.length("target")).alias("target_chars"))


def review_report(spark, d):
    """Every third decision reviewed: accepted, reverted or revised; what is wrong with the reviews."""
    own = newest_decisions(table(spark, d, "quality_decisions")).join(_pairs(spark, d).select("pair_id", "source", "target"), "pair_id").filter("source is not null")
    kind = F.element_at(F.array(F.lit("accept"), F.lit("revert"), F.lit("revise")), (F.pmod("pair_id", F.lit(3)) + 1).cast("int"))
    own = own.withColumn("kind", kind).withColumn("t", F.when(F.col("kind") == "accept", F.col("candidate")).when(F.col("kind") == "revert", F.col("source")).otherwise(F.col("target")))
    return own.groupBy("kind", F.coalesce(validation.review_issue(F.col("kind"), F.col("t"), F.col("source"), F.col("candidate")), F.lit("valid")).alias("issue")).agg(F.count("*").alias("reviews"))


def reviewed_outputs(spark, d):
    """Outputs with their reviews applied."""
    new = newest_decisions(table(spark, d, "quality_decisions")).filter("candidate is not null")
    outputs = new.select(F.col("pair_id").alias("key"), F.lit("simplified").alias("decision"), F.col("candidate").alias("target"))
    reviews = new.filter("pair_id % 2 = 0").join(_pairs(spark, d).filter("source is not null").select("pair_id", "source"), "pair_id")
    reviews = reviews.select(F.col("pair_id").alias("key"), F.when(F.col("accepted"), "accept").otherwise("revert").alias("decision"), F.when(F.col("accepted"), F.col("candidate")).otherwise(F.col("source")).alias("target"))
    return validation.apply_reviews(outputs, reviews).groupBy("decision", "reviewed").agg(F.count("*").alias("outputs"), F.sum(F.length("target")).alias("chars"))


def expected_answers(spark, d):
    """Targets against the candidates of all decisions on their pair."""
    given = table(spark, d, "quality_decisions").filter("candidate is not null").groupBy("pair_id").agg(F.array_sort(F.collect_set("candidate")).alias("expected"))
    own = _pairs(spark, d).filter("target is not null").join(given, "pair_id").select(validation.expected_match(F.col("target"), F.col("expected")).alias("m"))
    return own.groupBy("m.exact", "m.contains").agg(F.count("*").alias("pairs"))


def format_probes(spark, d):
    """Texts that are JSON objects, and texts whose first line has three short items."""
    own = table(spark, d, "text_records").filter("text is not null")
    return own.agg(F.count("*").alias("texts"), F.count_if(validation.is_json_object(F.col("text"))).alias("json_objects"), F.count_if(validation.three_items(F.col("text"))).alias("three_items"))


def stored_row_errors(spark, d):
    """Errors of stored conversations of several shapes."""
    roles = F.element_at(F.array(*(F.array(*map(F.lit, r)) for r in (("user", "assistant"), ("assistant", "user"), ("user", "user", "assistant"), ("user",), ("system", "user", "assistant")))), (F.pmod("pair_id", F.lit(5)) + 1).cast("int"))
    own = _pairs(spark, d).select(F.transform(roles, lambda r: F.struct(r.alias("role"), F.lit("x").alias("content"))).alias("m"), (F.length("source") * 10).alias("n"))
    return own.select(F.explode_outer(validation.row_errors(F.col("m"), F.col("n"))).alias("error")).groupBy("error").agg(F.count("*").alias("rows"))


def bundle_check(spark, d):
    return validation.bundle_report(table(spark, d, "text_records"), "text", 20)


def banned_texts(spark, d):
    """Documents by the first ban they fall under, and those that give advice where it is risky."""
    own = table(spark, d, "documents").filter("text is not null")
    return own.groupBy(F.coalesce(validation.ban_reason(F.col("text")), F.lit("none")).alias("ban")).agg(F.count("*").alias("documents"), F.count_if(F.regexp_like("text", F.lit(validation.ADVICE))).alias("advice"))


def curated_instructions(spark, d):
    own = _pairs(spark, d).filter("source is not null and target is not null")
    return own.groupBy("origin").agg(F.count("*").alias("pairs"), F.count_if(validation.curated_chinese(F.col("source"), F.col("target"))).alias("curated"))


def language_tags(spark, d):
    own = table(spark, d, "documents")
    return own.groupBy(sets.language_tag("lang").alias("tag")).agg(F.count("*").alias("documents"))


def ability_categories(spark, d):
    """Rows of all ability labels of two words put together, with their category."""
    words = [w for ws, _ in sets.ABILITIES for w in ws] + ["cooking"]
    own = spark.range(len(words) ** 2).select(*(F.element_at(F.array(*map(F.lit, words)), (n + 1).cast("int")).alias(c) for c, n in (("a", F.floor(F.col("id") / len(words))), ("b", F.col("id") % len(words)))))
    return own.select("a", "b", sets.ability_category(F.initcap(F.concat_ws(" ", "a", "b"))).alias("category"))


def chat_normalised(spark, d):
    """Each text as a message's content."""
    return _pairs(spark, d).select("pair_id", F.md5(tx.chat_text("source")).alias("source_digest"), F.length(tx.chat_text("target")).alias("target_chars"))


def question_answer_set(spark, d):
    """Pairs written as lines of a question-answer set, read back by its reader."""
    own = _pairs(spark, d).select("pair_id", F.coalesce("origin", F.lit("")).alias("instruction"), F.col("source").alias("input"), F.col("target").alias("output"), F.struct(F.array("split").alias("minor")).alias("task_type"))
    rows = readers.jsonl(spark, _written(own, "qa"), "pair_id bigint, instruction string, input string, output string, task_type struct<minor array<string>>", strict=True)
    got = sets.coig(rows.withColumn("number", F.col("pair_id")))
    return got.select("source_id", "category", "group_id", _told().alias("digest"))


def values_set(spark, d):
    """The same as pairs that need both a question and an answer."""
    own = _pairs(spark, d).select("pair_id", F.lit(None).cast("string").alias("instruction"), F.col("source").alias("input"), F.col("target").alias("output"))
    rows = readers.jsonl(spark, _written(own, "values"), "pair_id bigint, instruction string, input string, output string")
    return sets.human_values(rows.withColumn("number", F.col("pair_id"))).select("source_id", "group_id", _told().alias("digest"))


def reading_set(spark, d):
    """Long documents as passages whose terms to keep are the answers."""
    own = table(spark, d, "long_documents").select(F.concat_ws(":", "document_id", F.date_format("added_at", "yyyyMMddHHmmss")).alias("id"), F.col("source").alias("context"), F.col("category").alias("question"), F.col("must_keep").alias("answers"))
    path = scratch(spark, "reading")
    own.write.parquet(path)
    return sets.reading(spark.read.parquet(path), "cmrc2018").select("source_id", F.length(F.element_at("messages", 1)["content"]).alias("prompt_chars"), F.element_at("messages", 2)["content"].alias("answer"))


def conversation_set(spark, d):
    """Pairs with turns under other role names, scored; the reader keeps scores of 4 and more."""
    turns = F.array(F.struct(F.lit("Human").alias("role"), F.col("source").alias("content")), F.struct(F.lit("tool").alias("role"), F.lit("x").alias("content")), F.struct(F.lit("gpt").alias("role"), F.col("target").alias("content")))
    own = _pairs(spark, d).select(F.col("pair_id").alias("number"), turns.alias("conversations"), F.pmod("pair_id", F.lit(7)).alias("score"))
    path = scratch(spark, "turns")
    own.write.parquet(path)
    return sets.smoltalk(spark.read.parquet(path), "everyday").select("source_id", F.size("messages").alias("messages"), _told().alias("digest"))


def rewarded_set(spark, d):
    """Pairs with a reward and a language, through all rules of a rewarded set."""
    turns = F.array(F.struct(F.lit("human").alias("from"), F.col("source").alias("value")), F.struct(F.lit("gpt").alias("from"), F.col("target").alias("value")))
    label = F.struct(F.array(F.lit("Creativity")).alias("cate_ability_en"), F.array(F.coalesce("origin", F.lit(""))).alias("ability_en"))
    own = _pairs(spark, d).select(F.col("pair_id").cast("string").alias("id"), turns.alias("conversations"), label.alias("label"), F.when(F.pmod("pair_id", F.lit(9)) == 0, "EN_us").otherwise("zh-CN").alias("langdetect"), F.col("split").alias("source"), (F.pmod("pair_id", F.lit(11)) / 2).alias("reward"))
    got = sets.infinity(own, "set", "part", "zh", 2.0)
    return got.groupBy("source", "category").agg(F.count("*").alias("records"))


def reply_paths(spark, d):
    """Pairs as a forest of replies, ten trees deep by halves; the two best paths of each."""
    n = F.col("pair_id")
    own = _pairs(spark, d).select(n.alias("message_id"), F.when(n >= 20, F.floor(n / 2)).cast("bigint").alias("parent_id"), F.col("source").alias("text"), (n % 4).cast("int").alias("rank"), (n % 5).cast("int").alias("review_count")).filter("message_id >= 10")
    own = own.withColumn("message_tree_id", F.when(F.col("message_id") < 20, F.col("message_id")).otherwise(F.expr("cast(floor(message_id / pow(2, ceil(log2((message_id + 1) / 20.0)))) as bigint)")))
    steps = F.when(F.col("message_id") < 20, F.lit(0)).otherwise(F.expr("cast(ceil(log2((message_id + 1) / 20.0)) as int)"))
    own = own.withColumns({"role": F.when(steps % 2 == 0, "prompter").otherwise("assistant"), "lang": F.lit("zh"), "deleted": F.col("message_id") % 17 == 0, "review_result": F.when(F.col("message_id") % 3 == 0, True)})
    return sets.reply_tree_paths(own).select("source_id", "group_id", F.size("messages").alias("messages"))


def exam_questions(spark, d):
    """Documents by category as exam questions with four options, an even sample of at most 20 a category."""
    own = table(spark, d, "documents").filter("text is not null and category is not null")
    w = Window.partitionBy("category")
    own = own.withColumns({"i": F.row_number().over(w.orderBy("doc_id")) - 1, "n": F.count("*").over(w)})
    k = F.least(F.lit(20), F.col("n"))
    places = F.when(k == 1, F.array(F.floor(F.col("n") / 2))).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(k, F.lit(2)) - 1), lambda j: F.bround(j * (F.col("n") - 1) / (k - 1)).cast("bigint")))
    options = F.array(F.col("category"), F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.lit(" none "))
    q = choices.exam(F.col("category"), F.col("text"), options, F.pmod("doc_id", F.lit(4)))
    return own.filter(F.array_contains(places, F.col("i").cast("bigint"))).select("doc_id", q.alias("q")).select("doc_id", F.md5("q.context").alias("context"), F.array_join("q.options", "|").alias("options"), "q.answer_index")


def gap_questions(spark, d):
    """Sources with a comma as gap sentences; all kinds of choices over the same rows."""
    own = _pairs(spark, d).filter("source is not null and target is not null")
    s = F.replace("source", F.lit("，"), F.lit("_"))
    g = choices.gap(s, F.lit("，"), F.col("split"), F.lit(" 2 "))
    y = choices.yes_no(F.col("source"), F.concat("target", F.lit("??")), F.pmod("pair_id", F.lit(2)) == 0)
    e = choices.endings(F.concat(F.lit("[title] "), "source", F.lit(" [note]  x")), F.array("target", F.lit("[a] b")), F.coalesce("line_number", F.lit(-1)).cast("string"))
    return own.select("pair_id", F.md5("source").alias("of"), g["context"].alias("before"), F.md5(F.array_join(g["options"], "|")).alias("fillings"), F.md5(y["context"]).alias("asked"), y["answer_index"].alias("yes"), F.md5(F.array_join(e["options"], "|")).alias("endings"), e["answer_index"].alias("label"))


def spread_blocks(spark, d):
    """A sample of 100 documents from blocks of 40 spread over all."""
    own = ranking.global_rank(table(spark, d, "documents").select("doc_id"), ["doc_id"])
    return ranking.spread_blocks(own, "rank", 100, 40).select("doc_id")


def rotating_pick(spark, d):
    """Thirty picks in turn from the documents of two categories, begun at the seventh."""
    own = table(spark, d, "documents").filter("category in ('news', 'legal')").select("doc_id", F.when(F.col("category") == "news", 0).otherwise(1).alias("c"))
    return ranking.rotating_pick(ranking.global_rank(own, ["c", "doc_id"]), "rank", 30, 7).select("pick", "doc_id")


def layouts(spark, d):
    """The terms to keep of each document put together in each layout."""
    own = table(spark, d, "long_documents").filter("must_keep is not null and document_id is not null").select("document_id", F.explode(F.array(*map(F.lit, ("continuous", "line_per_sentence", "paragraphs", "mixed")))).alias("kind"), "must_keep")
    return own.select("document_id", "kind", choices.layout(F.col("must_keep"), F.col("kind")).alias("text"))


def union_audit(spark, d):
    """What keeps the files of all records from being those of odd and even sources together."""
    own = table(spark, d, "text_records").filter("source_file is not null")
    even = F.col("record_id") % 2 == 0
    state = validation.union_state(*(x.select(F.col("source_file").alias("file")) for x in (own.filter(even & (F.col("source_row") % 3 < 2)), own.filter(~even), own)))
    return state.groupBy("state").agg(F.count("*").alias("files"))


def resume_audit(spark, d):
    """Pairs done and pairs wanted, by place."""
    own = _pairs(spark, d).select(F.col("pair_id").alias("place"), "source", "target")
    done = own.withColumn("source", F.when(F.col("place") % 50 == 0, F.concat("source", F.lit("!"))).otherwise(F.col("source")))
    return validation.resume_state(done, own.filter("place % 70 <> 0")).groupBy("state").agg(F.count("*").alias("rows"))


def written_shards(spark, d):
    """Documents written in shards and read back: rows, and whether each shard is what its manifest says."""
    path = scratch(spark, "shards")
    own = table(spark, d, "documents").select("doc_id", "text")
    listed = sinks.write_shards(own, path, 500)
    same = sinks.verify(spark, path, listed)
    back = readers.jsonl(spark, path, "doc_id bigint, text string", strict=True)
    changed = same.filter(F.col("state") != "same").count()
    return back.agg(F.count("*").alias("rows"), F.sum("doc_id").alias("ids"), F.sum(F.length("text")).alias("chars")).withColumn("changed", F.lit(changed).cast("bigint"))


def token_cache(spark, d):
    """Documents' characters as ids, written in shards, read back and checked."""
    docs = table(spark, d, "documents").filter("text is not null")
    ids = tokens.encode_chars(docs, tokens.char_vocabulary(docs, "text", None), "doc_id", "text")
    path = scratch(spark, "cache")
    cache.write_cache(ids, path, "doc_id", "tokens", 20_000, 200_000)
    back = cache.read_cache(spark, path)
    wrong = cache.cache_errors(back, 1_200_000, 20_000).count()
    return back.groupBy("group", "shard").agg(F.count("*").alias("documents"), F.sum(F.size("tokens")).alias("tokens")).withColumn("errors", F.lit(wrong).cast("bigint"))


def content_identity(spark, d):
    own = table(spark, d, "documents").select("doc_id", F.coalesce("category", F.lit("")).alias("category"))
    return cache.content_digest(own, ["doc_id"])


def run_preflight(spark, d):
    return cache.preflight(_pairs(spark, d))


def generation_prompts(spark, d):
    """Each pair's question in four templates."""
    own = _pairs(spark, d)
    return own.select("pair_id", *(F.md5(forms.generation_prompt(F.col("source"), F.col("origin"), t)).alias(t) for t in ("chatml", "alpaca", "chinese_alpaca", "legacy")))


def formatted_numbers(spark, d):
    """Orders' keys as bytes and as seconds, and the softmax of three measures of each."""
    own = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    p = tx.softmax(F.array(*((F.col("k") % m).cast("double") / m for m in (3, 5, 7))))
    return own.select("k", tx.bytes_text(F.col("k") * F.col("k") * 7919).alias("bytes"), tx.duration_text(F.col("k") - 100).alias("duration"), F.round(p[0], 9).alias("p0"), F.round(p[2], 9).alias("p2"))


def _chat(c: str) -> str:
    """The SQL of tx.chat_text."""
    t = f"regexp_replace(replace(regexp_replace(coalesce({c}, ''), '\\r\\n?', chr(10), 'g'), chr(0), ''), '[ \\t]+', ' ', 'g')"
    t = f"regexp_replace({t}, '(?m)^[ \\x{{a0}}\\x{{3000}}]+|[ \\x{{a0}}\\x{{3000}}]+$', '', 'g')"
    for _ in range(2):
        t = f"regexp_replace({t}, '([\\x{{3400}}-\\x{{9fff}}]) +([\\x{{3400}}-\\x{{9fff}}])', '\\1\\2', 'g')"
    t = f"regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"regexp_replace({t}, '^[\\s\\p{{Z}}\\x{{0b}}\\x{{1c}}-\\x{{1f}}\\x{{85}}]+|[\\s\\p{{Z}}\\x{{0b}}\\x{{1c}}-\\x{{1f}}\\x{{85}}]+$', '', 'g')"


_STRIP = lambda c: f"regexp_replace({c}, '^[\\s\\p{{Z}}\\x{{0b}}\\x{{1c}}-\\x{{1f}}\\x{{85}}]+|[\\s\\p{{Z}}\\x{{0b}}\\x{{1c}}-\\x{{1f}}\\x{{85}}]+$', '', 'g')"
_SIG = lambda c: f"regexp_replace({c}, '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
_NUMS = lambda c: f"list_sort(regexp_extract_all({c}, '\\p{{Nd}}+(?:[.:：/\\-—]\\p{{Nd}}+)*%?'))"
_ALL = lambda c, p: f"list_sort(regexp_extract_all({c}, '{p}'))"
_SPANS = lambda c: "list_sort(flatten([" + ", ".join(
    f"list_transform(regexp_extract_all({c}, '{p}', 1), lambda x: '{k}:' || {_SIG('x')})"
    for k, p in (("book", "《([^《》]*)》"), ("quote", "“([^“”]*)”"), ("quote", "「([^「」]*)」"), ("quote", "『([^『』]*)』"), ("bracket", "【([^【】]*)】"), ("bracket", "\\(([^()]*)\\)"), ("bracket", "（([^（）]*)）"))
) + "]))"
_SCOPE = "并没有|不再|不得|不能|不会|尚未|并非|没有|至少|至多|不超过|不少于|不低于|超过|低于|高于|可能|也许|或许|大约|预计|有望|应当|应该|必须|再次|仍然|仍旧|持续|进一步|明确|甚至|可以说|也"
_NEW = "n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY decided_at DESC NULLS LAST, decision_id DESC) AS rn FROM quality_decisions WHERE pair_id IS NOT NULL) WHERE rn = 1)"
_WB = lambda p: f"(^|[^\\p{{L}}\\p{{N}}_])({p})($|[^\\p{{L}}\\p{{N}}_])"
_SURFACE = lambda c: f"lower(regexp_replace(regexp_replace({c}, '[\\s\\p{{Z}}\\x{{0b}}\\x{{1c}}-\\x{{1f}}\\x{{85}}]+', '', 'g'), '[^\\p{{L}}\\p{{N}}_\\x{{3400}}-\\x{{9fff}}]+', '', 'g'))"
_ANSWER = lambda c: f"regexp_replace(regexp_replace({c}, '[\\s\\p{{Z}}\\x{{0b}}\\x{{1c}}-\\x{{1f}}\\x{{85}}]+', '', 'g'), '[。！？.!?]+$', '')"
_PLACES = "CASE WHEN k = 1 THEN [n // 2] ELSE list_transform(range(0, k), lambda j: CAST(round_even(j * (n - 1) / (k - 1), 0) AS BIGINT)) END"
SQL = {
    "record_filter": f"""
        WITH m AS (SELECT {_chat("source")} AS s, {_chat("target")} AS t FROM pair_records), r AS (SELECT *, s || chr(10) || t AS raw, list_filter(regexp_split_to_array(lower(s || chr(10) || t), '[\\s]+'), lambda x: true) AS w FROM m)
        SELECT CASE WHEN s = '' OR t = '' THEN 'too_few_messages' WHEN length(s) + length(t) < 12 THEN 'too_short' WHEN greatest(length(s), length(t)) > 12000 THEN 'single_message_too_long'
            WHEN regexp_matches(raw, '(?i)</?think>|</?analysis>') THEN 'visible_think_tags' WHEN regexp_matches(raw, '(?i)<tool_(?:call|response)>|<\\|im_(?:start|end)\\|>') THEN 'foreign_chat_marker'
            WHEN regexp_matches(s, '(?i)(?:^|\\n)\\s*(?:assistant|助手|助理)\\s*(?::|：|\\n)') THEN 'embedded_assistant_text'
            WHEN regexp_matches(raw, '[\\x{{0400}}-\\x{{04ff}}\\x{{0600}}-\\x{{06ff}}\\x{{0e00}}-\\x{{0e7f}}\\x{{3040}}-\\x{{30ff}}\\x{{ac00}}-\\x{{d7af}}\\x{{fb50}}-\\x{{fdff}}]') THEN 'unexpected_script_mixing'
            WHEN len(list_filter(range(1, len(w) - 2), lambda i: regexp_full_match(w[i + 1], '[a-z]{{3,}}') AND w[i + 1] = w[i + 2] AND regexp_matches(w[i], '(^|[^a-z0-9_])' || w[i + 1] || '$') AND starts_with(w[i + 3], w[i + 1]))) > 0 THEN 'repeated_latin_noise'
            WHEN regexp_matches(raw, '(?i)(?:^|[\\s，。！？])goal(?:[!\\s，。！？]|$)') THEN 'everyday_goal_leak'
            WHEN regexp_matches(raw, '(?i)_measurement|_(?:fieldName|value)\\d*|GetUserProblemByUid|parentId|divisbble|[\\x{{3400}}-\\x{{9fff}}]\\s+intersections\\s+[\\x{{3400}}-\\x{{9fff}}]|(?:^|\\n)\\s*(?:disgusting|horrible|terrible)\\s+merger\\b|(?:不相关|无关)(?:的)?(?:主题|内容).{{0,24}}(?:忽略|无视)|(?:忽略|无视).{{0,24}}(?:不相关|无关)(?:的)?(?:主题|内容)') THEN 'smoltalk_template_artifact'
            WHEN contains(raw, chr(65533)) THEN 'replacement_character' WHEN regexp_matches(raw, '[\\x00-\\x08\\x0b-\\x1f]') THEN 'control_character'
            WHEN regexp_matches(t, '(?i)(?:作为|身为).{{0,12}}(?:AI|人工智能|语言模型)|(?:我是|我只是|我虽然是).{{0,8}}(?:AI|人工智能|语言模型)|我(?:并)?没有(?:真实的)?(?:感情|情感)|开源语言模型') THEN 'assistant_model_identity'
            WHEN length(s) + length(t) > 512 THEN 'over_max_tokens' WHEN length(t) < 2 THEN 'assistant_too_short' ELSE 'accepted' END AS reason, count(*) AS pairs FROM r GROUP BY 1""",
    "target_issues": f"""
        WITH p AS (SELECT source AS s, target AS t FROM pair_records WHERE source IS NOT NULL AND target IS NOT NULL)
        SELECT CASE WHEN {_ALL("s", "\\p{Nd}+(?:[.,，．]\\p{Nd}+)*(?:[%％])?")} <> {_ALL("t", "\\p{Nd}+(?:[.,，．]\\p{Nd}+)*(?:[%％])?")} THEN 'numbers_changed'
            WHEN {_ALL("s", "[A-Za-z]+(?:[._-][A-Za-z]+)*")} <> {_ALL("t", "[A-Za-z]+(?:[._-][A-Za-z]+)*")} THEN 'latin_terms_changed' WHEN {_SPANS("s")} <> {_SPANS("t")} THEN 'protected_text_changed'
            WHEN {_ALL("s", _SCOPE)} <> {_ALL("t", _SCOPE)} THEN 'scope_terms_changed'
            WHEN s <> t AND {_SIG("s")} = {_SIG("t")} AND (length(s) < 40 OR len(regexp_extract_all(t, '[。！？!?;；]')) <= len(regexp_extract_all(s, '[。！？!?;；]'))) THEN 'only_marks_changed'
            WHEN s <> t AND length(s) >= 20 AND length(t) < length(s) * 0.8 THEN 'too_much_removed' WHEN s <> t AND length(t) > greatest(length(s) + 8, floor(length(s) * 1.05)) THEN 'too_long' ELSE 'kept' END AS issue, count(*) AS pairs FROM p GROUP BY 1""",
    "output_issue_report": f"""
        WITH {_NEW}, o AS (SELECT pair_id, CASE WHEN accepted THEN 'simplified' WHEN NOT accepted THEN 'keep' ELSE '' END AS decision, coalesce(candidate, '') AS t, true AS has FROM n),
        j AS (SELECT p.pair_id AS a, o.pair_id AS b, coalesce(p.source, '') AS s, o.decision, o.t FROM pair_records p FULL JOIN o ON p.pair_id = o.pair_id)
        SELECT code, count(*) AS issues FROM (SELECT unnest([CASE WHEN b IS NULL THEN 'missing_output' END, CASE WHEN a IS NULL THEN 'extra_output' END, CASE WHEN a IS NOT NULL AND b IS NOT NULL AND decision = '' THEN 'invalid_decision' END,
            CASE WHEN a IS NOT NULL AND b IS NOT NULL AND {_STRIP("t")} = '' THEN 'empty_target' END, CASE WHEN a IS NOT NULL AND decision = 'keep' AND t <> s THEN 'keep_changed_text' END, CASE WHEN a IS NOT NULL AND decision = 'simplified' AND t = s THEN 'simplified_is_identity' END,
            CASE WHEN a IS NOT NULL AND decision = 'simplified' AND {_NUMS("s")} <> {_NUMS("t")} THEN 'number_mismatch' END]) AS code FROM j) WHERE code IS NOT NULL GROUP BY 1""",
    "surface_revert_report": f"""
        WITH p AS (SELECT source AS s, target AS t, source <> target AND {_SURFACE("source")} = {_SURFACE("target")} AS r FROM pair_records WHERE source IS NOT NULL AND target IS NOT NULL)
        SELECT CASE WHEN r THEN 'keep' ELSE 'simplified' END AS decision, count(*) AS pairs, count(*) FILTER (WHERE r) AS reverted, CAST(sum(length(CASE WHEN r THEN s ELSE t END)) AS BIGINT) AS target_chars FROM p GROUP BY 1""",
    "review_report": f"""
        WITH {_NEW}, j AS (SELECT p.source AS s, n.candidate AS c, p.target AS o, ['accept', 'revert', 'revise'][n.pair_id % 3 + 1] AS kind FROM n JOIN pair_records p USING (pair_id) WHERE p.source IS NOT NULL),
        t AS (SELECT *, CASE kind WHEN 'accept' THEN c WHEN 'revert' THEN s ELSE o END AS t FROM j)
        SELECT kind, CASE WHEN {_STRIP("coalesce(t, '')")} = '' THEN 'invalid_decision_or_target' WHEN kind = 'revise' AND t = s THEN 'revision_equals_source' WHEN kind = 'revise' AND {_NUMS("s")} <> {_NUMS("t")} THEN 'revision_changes_numbers' ELSE 'valid' END AS issue, count(*) AS reviews FROM t GROUP BY 1, 2""",
    "reviewed_outputs": f"""
        WITH {_NEW}, o AS (SELECT n.pair_id, candidate, accepted, p.source, n.pair_id % 2 = 0 AND p.source IS NOT NULL AS reviewed FROM n LEFT JOIN pair_records p USING (pair_id) WHERE candidate IS NOT NULL)
        SELECT CASE WHEN reviewed AND accepted IS NOT TRUE THEN 'keep' ELSE 'simplified' END AS decision, reviewed, count(*) AS outputs, CAST(sum(length(CASE WHEN reviewed AND accepted IS NOT TRUE THEN source ELSE candidate END)) AS BIGINT) AS chars FROM o GROUP BY 1, 2""",
    "expected_answers": f"""
        WITH g AS (SELECT pair_id, list(DISTINCT candidate) AS e FROM quality_decisions WHERE candidate IS NOT NULL GROUP BY 1), j AS (SELECT {_ANSWER("target")} AS o, list_transform(e, lambda x: {_ANSWER("x")}) AS a, len(list_filter(e, lambda x: {_STRIP("x")} <> '')) AS k FROM pair_records JOIN g USING (pair_id) WHERE target IS NOT NULL)
        SELECT CASE WHEN k > 0 THEN list_contains(a, o) END AS exact, CASE WHEN k > 0 THEN len(list_filter(a, lambda x: contains(o, x))) > 0 END AS contains, count(*) AS pairs FROM j GROUP BY 1, 2""",
    "format_probes": f"""
        WITH t AS (SELECT {_STRIP("text")} AS t FROM text_records WHERE text IS NOT NULL), i AS (SELECT t, list_filter(list_transform(regexp_split_to_array(regexp_extract(t, '^[^\\n\\r]*'), '[，,、]'), lambda x: {_STRIP("x")}), lambda x: x <> '') AS i FROM t)
        SELECT count(*) AS texts, count(*) FILTER (WHERE json_valid(t) AND starts_with(t, '{{')) AS json_objects, count(*) FILTER (WHERE len(i) = 3 AND len(list_filter(i, lambda x: length(x) > 12)) = 0) AS three_items FROM i""",
    "stored_row_errors": """
        WITH p AS (SELECT pair_id % 5 AS k, coalesce(length(source) * 10, 0) AS n FROM pair_records), e AS (SELECT CASE WHEN k = 3 THEN ['invalid_messages'] ELSE list_filter([CASE WHEN k = 1 THEN 'invalid_boundary_roles' END, CASE WHEN k = 2 THEN 'roles_not_alternating' END, CASE WHEN n > 2048 THEN 'too_many_tokens' END], lambda x: x IS NOT NULL) END AS e FROM p)
        SELECT error, count(*) AS rows FROM (SELECT unnest(CASE WHEN len(e) = 0 THEN [NULL] ELSE e END) AS error FROM e) GROUP BY 1""",
    "bundle_check": f"""
        SELECT count(*) AS documents, count(*) FILTER (WHERE text IS NULL) AS nulls, count(*) FILTER (WHERE {_STRIP("text")} = '') AS blanks, count(*) FILTER (WHERE length(text) < 20) AS too_short, count(text) - count(DISTINCT text) AS duplicates,
        CAST(min(length(text)) AS INTEGER) AS min_chars, CAST(max(length(text)) AS INTEGER) AS max_chars, round(avg(length(text)), 4) AS mean_chars FROM text_records""",
    "banned_texts": f"""
        SELECT CASE WHEN regexp_matches(text, '(?i){_WB("ChatGPT|OpenAI|Claude|Gemini|Llama|as an AI|as a language model")}|我是(?:ChatGPT|Claude|Gemini)|作为(?:一个)?(?:AI|人工智能|语言模型)') THEN 'identity'
            WHEN regexp_matches(text, '(?i){_WB("diagnos(?:e|is)|dosage|prescription|medical advice|legal advice|investment advice|stock recommendation|latest|today|current president|current law|breaking news")}|诊断|处方|剂量|服药|医疗建议|法律建议|投资建议|股票推荐|最新消息|今天的新闻|现任总统|现行法律') THEN 'high_stakes'
            WHEN regexp_matches(text, '(?i){_WB("ransomware|keylogger|credential theft|steal passwords|phishing kit|make a bomb|build a bomb|poison someone|evade law enforcement|swiss army knife|throwing knife|knife throwing|criminal suspect|profile a suspect")}|勒索软件|键盘记录器|窃取密码|钓鱼网站|制作炸弹|制造炸弹|投毒|逃避执法|瑞士军刀|飞刀|投掷.{{0,10}}(?:刀|军刀)|犯罪嫌疑人|刑事侦查|犯罪画像') THEN 'harmful'
            WHEN regexp_matches(text, '(?m)<\\|im_(?:start|end)\\|>|<tool_(?:call|response)>|<<[^<>\\n]{{1,120}}>>|^\\s*####\\s*') THEN 'artifact' WHEN regexp_matches(text, '(?i){_WB("MMLU|GSM8K|HumanEval|MBPP|AlpacaEval|MT-Bench|Arena-Hard")}') THEN 'benchmark' ELSE 'none' END AS ban,
            count(*) AS documents, count(*) FILTER (WHERE regexp_matches(text, '诊断|治疗|药物|处方|剂量|服用|手术|怀孕|孕期|症状|股票|投资|诉讼|法律意见')) AS advice FROM documents WHERE text IS NOT NULL GROUP BY 1""",
    "curated_instructions": """
        WITH p AS (SELECT origin, source AS q, target AS a, len(regexp_extract_all(source || chr(10) || target, '[\\x{3400}-\\x{9fff}]')) AS han, len(regexp_extract_all(source || chr(10) || target, '[A-Za-z]')) AS latin FROM pair_records WHERE source IS NOT NULL AND target IS NOT NULL)
        SELECT origin, count(*) AS pairs, count(*) FILTER (WHERE han >= 12 AND latin <= greatest(24, floor(han * 0.25)) AND NOT regexp_matches(q, '^(?:在这个任务中|在这项任务中|在本任务中|你会得到|你将得到|给定一组)')
            AND NOT (regexp_matches(a, '^\\s*[A-Da-d]\\s*[)）.、:：]') AND len(regexp_extract_all(q, '(?:^|\\n)\\s*[A-Da-d]\\s*[)）.、:：]')) < 2) AND length(q) <= 1200 AND length(a) <= 1600) AS curated FROM p GROUP BY 1""",
    "language_tags": f"WITH t AS (SELECT replace(lower({_chat('lang')}), '_', '-') AS t FROM documents) SELECT CASE WHEN starts_with(t, 'zh') THEN 'zh' WHEN starts_with(t, 'en') THEN 'en' ELSE t END AS tag, count(*) AS documents FROM t GROUP BY 1",
    "ability_categories": """
        WITH w AS (SELECT unnest(['programming', 'software development', 'code', 'mathematical', 'calculation', 'arithmetic', 'logic', 'reasoning', 'creativity', 'creative writing', 'humanities', 'history', 'philosophy', 'sociology', 'data science', 'data analysis', 'analytics', 'information processing', 'knowledge', 'fact checking', 'problem solving', 'support', 'planning', 'writing', 'language', 'translation', 'cooking']) AS w),
        t AS (SELECT a.w AS a, b.w AS b, a.w || ' ' || b.w AS t FROM w a, w b)
        SELECT a, b, CASE WHEN regexp_matches(t, 'programming|software development|code') THEN 'code_and_programming' WHEN regexp_matches(t, 'mathematical|calculation|arithmetic') THEN 'mathematical_reasoning' WHEN regexp_matches(t, 'logic|reasoning') THEN 'logical_reasoning' WHEN regexp_matches(t, 'creativity|creative writing') THEN 'creative_writing'
            WHEN regexp_matches(t, 'humanities|history|philosophy|sociology') THEN 'humanities_knowledge' WHEN regexp_matches(t, 'data science|data analysis|analytics') THEN 'data_analysis' WHEN regexp_matches(t, 'information processing|knowledge|fact checking') THEN 'knowledge_qa' WHEN regexp_matches(t, 'problem solving|support|planning') THEN 'planning_advice'
            WHEN regexp_matches(t, 'writing|language|translation') THEN 'writing_revision' ELSE 'general_instruction' END AS category FROM t""",
    "chat_normalised": f"SELECT pair_id, md5({_chat('source')}) AS source_digest, CAST(length({_chat('target')}) AS INTEGER) AS target_chars FROM pair_records",
    "question_answer_set": f"""
        WITH m AS (SELECT pair_id, split, {_chat("origin")} AS i, {_chat("source")} AS s, {_chat("target")} AS t FROM pair_records)
        SELECT CAST(pair_id AS VARCHAR) AS source_id, coalesce(split, 'general') AS category, 'coig:' || pair_id AS group_id, md5('user:' || CASE WHEN s = '' THEN i WHEN i = '' THEN s ELSE i || chr(10) || chr(10) || s END || chr(10) || 'assistant:' || t) AS digest FROM m""",
    "values_set": f"""
        WITH m AS (SELECT pair_id, {_chat("source")} AS s, {_chat("target")} AS t FROM pair_records)
        SELECT CAST(pair_id AS VARCHAR) AS source_id, 'coig_human_value:' || pair_id AS group_id, md5('user:' || s || chr(10) || 'assistant:' || t) AS digest FROM m WHERE s <> '' AND t <> ''""",
    "reading_set": f"""
        WITH m AS (SELECT document_id || ':' || strftime(added_at, '%Y%m%d%H%M%S') AS id, {_chat("source")} AS c, {_chat("category")} AS q, {_chat("must_keep[1]")} AS a FROM long_documents)
        SELECT id AS source_id, CAST(length('请根据给定材料回答问题，只依据材料，不补充材料外的信息。' || chr(10) || '材料：' || c || chr(10) || '问题：' || q) AS INTEGER) AS prompt_chars, a AS answer FROM m WHERE c <> '' AND q <> '' AND a <> '' AND contains(c, a)""",
    "conversation_set": f"""
        WITH m AS (SELECT pair_id, {_chat("source")} AS s, {_chat("target")} AS t FROM pair_records WHERE pair_id % 7 >= 4)
        SELECT 'everyday:' || pair_id AS source_id, CAST((s <> '')::INT + (t <> '')::INT AS INTEGER) AS messages, md5(array_to_string(list_filter([CASE WHEN s <> '' THEN 'user:' || s END, CASE WHEN t <> '' THEN 'assistant:' || t END], lambda x: x IS NOT NULL), chr(10))) AS digest FROM m WHERE s <> '' OR t <> ''""",
    "rewarded_set": f"""
        WITH m AS (SELECT {_chat("source")} AS s, {_chat("target")} AS t FROM pair_records WHERE pair_id % 9 <> 0 AND (pair_id % 11) / 2 >= 2.0), r AS (SELECT *, s || chr(10) || t AS raw FROM m WHERE s <> '' AND t <> '')
        SELECT 'set_zh' AS source, 'creative_writing' AS category, count(*) AS records FROM r WHERE NOT regexp_matches(t, '(?i){_WB("ChatGPT|OpenAI|Claude|Gemini|Llama|as an AI|as a language model")}|我是(?:ChatGPT|Claude|Gemini)|作为(?:一个)?(?:AI|人工智能|语言模型)')
            AND NOT regexp_matches(raw, '(?i){_WB("diagnos(?:e|is)|dosage|prescription|medical advice|legal advice|investment advice|stock recommendation|latest|today|current president|current law|breaking news")}|诊断|处方|剂量|服药|医疗建议|法律建议|投资建议|股票推荐|最新消息|今天的新闻|现任总统|现行法律|勒索软件|键盘记录器|窃取密码|钓鱼网站|制作炸弹|制造炸弹|投毒|逃避执法|瑞士军刀|飞刀|犯罪嫌疑人|刑事侦查|犯罪画像')
            AND NOT regexp_matches(raw, '(?m)<\\|im_(?:start|end)\\|>|<tool_(?:call|response)>|<<[^<>\\n]{{1,120}}>>|^\\s*####\\s*|MMLU|GSM8K|HumanEval') HAVING count(*) > 0""",
    "reply_paths": f"""
        WITH RECURSIVE v AS (SELECT pair_id AS id, CASE WHEN pair_id >= 20 THEN pair_id // 2 END AS up, {_chat("source")} AS s, pair_id % 4 AS rk, pair_id % 5 AS rv FROM pair_records WHERE pair_id >= 10 AND pair_id % 17 <> 0),
        p AS (SELECT id, id AS tree, 0 AS depth, (s <> '')::INT AS n, rk, rv FROM v WHERE up IS NULL UNION ALL SELECT v.id, p.tree, p.depth + 1, p.n + (v.s <> '')::INT, v.rk, v.rv FROM p JOIN v ON v.up = p.id),
        r AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY n DESC, rk - rv, id) AS rn FROM p WHERE depth % 2 = 1)
        SELECT CAST(id AS VARCHAR) AS source_id, 'oasst2:' || tree AS group_id, CAST(n AS INTEGER) AS messages FROM r WHERE rn <= 2""",
    "exam_questions": f"""
        WITH d AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY category) AS n FROM documents WHERE text IS NOT NULL AND category IS NOT NULL), k AS (SELECT *, least(20, n) AS k FROM d)
        SELECT doc_id, md5('The following are multiple choice questions (with answers) about ' || replace(category, '_', ' ') || '.' || chr(10) || chr(10) || {_STRIP("text")} || chr(10) || 'A. ' || {_STRIP("category")} || chr(10) || 'B. ' || {_STRIP("coalesce(source, '')")} || chr(10) || 'C. ' || {_STRIP("coalesce(lang, '')")} || chr(10) || 'D. none' || chr(10) || 'Answer:') AS context,
            ' A| B| C| D' AS options, CAST(doc_id % 4 AS INTEGER) AS answer_index FROM k WHERE list_contains({_PLACES}, i)""",
    "gap_questions": f"""
        WITH p AS (SELECT *, replace(source, '，', '_') AS s FROM pair_records WHERE source IS NOT NULL AND target IS NOT NULL), g AS (SELECT *, string_split(s, '_') AS w FROM p)
        SELECT pair_id, md5(source) AS "of", CASE WHEN len(w) = 2 THEN w[1] END AS "before", CASE WHEN len(w) = 2 THEN md5('，' || w[2] || '|' || coalesce(split || w[2], '')) END AS fillings, md5({_STRIP("source")} || chr(10) || 'Question: ' || rtrim({_STRIP("target || '??'")}, '?') || '?' || chr(10) || 'Answer:') AS asked,
            CAST((pair_id % 2 = 0)::INT AS INTEGER) AS yes, CASE WHEN line_number >= 0 THEN md5(' ' || {_STRIP("regexp_replace(regexp_replace(replace(target, '[title]', ' '), '\\[[^\\]]*\\]', ' ', 'g'), '[\\s\\p{Z}\\x{0b}]+', ' ', 'g')")} || '| b') END AS endings, CASE WHEN line_number >= 0 THEN CAST(line_number AS INTEGER) END AS label FROM g""",
    "spread_blocks": """
        WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rn, count(*) OVER () AS n FROM documents), o AS (SELECT DISTINCT CAST(round_even(i * greatest(0, n - 40) / 2.0, 0) AS BIGINT) AS o FROM (SELECT max(n) AS n FROM r), range(0, 3) t(i)),
        b AS (SELECT doc_id, row_number() OVER (ORDER BY rn) - 1 AS i, count(*) OVER () AS n FROM r WHERE EXISTS (SELECT 1 FROM o WHERE rn >= o AND rn < o + 40)), k AS (SELECT *, least(100, n) AS k FROM b)
        SELECT doc_id FROM k WHERE list_contains(list_transform(range(0, k), lambda j: CAST(round_even(j * (n - 1) / (k - 1), 0) AS BIGINT)), i)""",
    "rotating_pick": "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY category = 'legal', doc_id) - 1 AS rn, count(*) OVER () AS n FROM documents WHERE category IN ('news', 'legal')) SELECT CAST(i AS BIGINT) AS pick, doc_id FROM range(0, 30) t(i) JOIN r ON rn = (i + 7) % n",
    "layouts": """
        WITH l AS (SELECT document_id, must_keep AS t, unnest(['continuous', 'line_per_sentence', 'paragraphs', 'mixed']) AS kind FROM long_documents WHERE must_keep IS NOT NULL AND document_id IS NOT NULL)
        SELECT document_id, kind, CASE kind WHEN 'continuous' THEN coalesce(array_to_string(t, ''), '') WHEN 'line_per_sentence' THEN coalesce(array_to_string(t, chr(10)), '') WHEN 'paragraphs' THEN coalesce(array_to_string(list_transform(range(0, (len(t) + 3) // 4), lambda i: array_to_string(t[i * 4 + 1 : i * 4 + 4], '')), chr(10) || chr(10)), '')
            ELSE coalesce(array_to_string(list_transform(range(0, (len(t) + 2) // 3), lambda i: array_to_string(t[i * 3 + 1 : i * 3 + 3], '')), chr(10)), '') END AS text FROM l""",
    "union_audit": """
        WITH f AS (SELECT source_file AS f, bool_or(record_id % 2 = 0 AND source_row % 3 < 2) AS b, bool_or(record_id % 2 <> 0) AS e FROM text_records WHERE source_file IS NOT NULL GROUP BY 1)
        SELECT state, count(*) AS files FROM (SELECT CASE WHEN coalesce(b, false) AND coalesce(e, false) THEN 'in_both' WHEN NOT coalesce(b, false) AND NOT coalesce(e, false) THEN 'only_in_full' END AS state FROM f) WHERE state IS NOT NULL GROUP BY 1""",
    "resume_audit": "SELECT state, count(*) AS rows FROM (SELECT CASE WHEN pair_id % 70 = 0 THEN 'beyond_input' WHEN pair_id % 50 = 0 AND source IS NOT NULL THEN 'source_differs' WHEN coalesce(target, '') = '' THEN 'invalid_target' END AS state FROM pair_records) WHERE state IS NOT NULL GROUP BY 1",
    "generation_prompts": f"""
        WITH p AS (SELECT pair_id, {_STRIP("coalesce(source, '')")} AS q, {_STRIP("coalesce(origin, '')")} AS x FROM pair_records)
        SELECT pair_id, md5('<|im_start|>system' || chr(10) || 'You are a helpful assistant.<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || q || CASE WHEN x = '' THEN '' ELSE chr(10) || chr(10) || x END || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)) AS chatml,
            md5('### Instruction:' || chr(10) || q || CASE WHEN x = '' THEN '' ELSE chr(10) || chr(10) || '### Input:' || chr(10) || x END || chr(10) || chr(10) || '### Response:' || chr(10)) AS alpaca,
            md5('### 指令：' || chr(10) || q || CASE WHEN x = '' THEN '' ELSE chr(10) || chr(10) || '### 输入：' || chr(10) || x END || chr(10) || chr(10) || '### 回答：' || chr(10)) AS chinese_alpaca,
            md5('用户：' || q || CASE WHEN x = '' THEN '' ELSE chr(10) || '输入：' || x END || chr(10) || '助手：') AS legacy FROM p""",
    "formatted_numbers": """
        WITH k AS (SELECT o_orderkey AS k, o_orderkey::BIGINT * o_orderkey * 7919 AS v, greatest(o_orderkey - 100, 0) AS s, exp((o_orderkey % 3) / 3.0::DOUBLE) AS a, exp((o_orderkey % 5) / 5.0::DOUBLE) AS b, exp((o_orderkey % 7) / 7.0::DOUBLE) AS c FROM orders)
        SELECT k, CASE WHEN v < 1024 THEN printf('%d B', v) WHEN v < 1048576 THEN printf('%.2f KB', v / 1024.0::DOUBLE) WHEN v < 1073741824 THEN printf('%.2f MB', v / 1048576.0::DOUBLE) WHEN v < 1099511627776 THEN printf('%.2f GB', v / 1073741824.0::DOUBLE) ELSE printf('%.2f TB', v / 1099511627776.0::DOUBLE) END AS bytes,
            printf('%02d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) AS duration, round(a / (a + b + c), 9) AS p0, round(c / (a + b + c), 9) AS p2 FROM k""",
    "token_cache": """
        WITH RECURSIVE d AS (SELECT doc_id, length(text) + 2 AS n FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, n, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 200000 AS g FROM d), o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id) AS i FROM s),
        r AS (SELECT g, i, n AS used, 0 AS shard, n FROM o WHERE i = 1 UNION ALL SELECT o.g, o.i, CASE WHEN r.used > 0 AND r.used + o.n > 20000 THEN o.n ELSE r.used + o.n END, CASE WHEN r.used > 0 AND r.used + o.n > 20000 THEN r.shard + 1 ELSE r.shard END, o.n FROM r JOIN o ON o.g = r.g AND o.i = r.i + 1)
        SELECT CAST(g AS BIGINT) AS "group", shard, count(*) AS documents, CAST(sum(n) AS BIGINT) AS tokens, CAST(0 AS BIGINT) AS errors FROM r GROUP BY 1, 2""",
    "content_identity": """
        WITH h AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, sha256('{"category":"' || coalesce(category, '') || '","doc_id":' || doc_id || '}') AS h FROM documents), b AS (SELECT i // 1000 AS b, CASE WHEN (SELECT count(*) FROM h) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM h GROUP BY 1)
        SELECT (SELECT count(*) FROM documents) AS rows, CASE WHEN count(*) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY b)) END AS digest FROM b""",
    "run_preflight": f"""
        WITH p AS (SELECT lower(trim(split)) AS split, source, target FROM pair_records), t AS (SELECT DISTINCT source FROM p WHERE split = 'train' AND source IS NOT NULL)
        SELECT split, count(*) AS rows, count(*) FILTER (WHERE {_STRIP("coalesce(source, '')")} = '' OR {_STRIP("coalesce(target, '')")} = '') AS unusable, count(*) FILTER (WHERE regexp_matches(coalesce(source, '') || chr(10) || coalesce(target, ''), '<\\|[A-Za-z_]+\\|>')) AS labelled,
            count(*) FILTER (WHERE split <> 'train' AND source IN (SELECT source FROM t)) AS also_in_train FROM p GROUP BY 1""",
    "written_shards": "SELECT count(*) AS rows, CAST(sum(doc_id) AS BIGINT) AS ids, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(0 AS BIGINT) AS changed FROM documents",
}
QUERIES = (
    record_filter, target_issues, output_issue_report, surface_revert_report, review_report, reviewed_outputs, expected_answers, format_probes, stored_row_errors, bundle_check, banned_texts, curated_instructions, language_tags, ability_categories,
    chat_normalised, question_answer_set, values_set, reading_set, conversation_set, rewarded_set, reply_paths, exam_questions, gap_questions, spread_blocks, rotating_pick, layouts, union_audit, resume_audit, written_shards, token_cache, content_identity, run_preflight, generation_prompts, formatted_numbers,
)
