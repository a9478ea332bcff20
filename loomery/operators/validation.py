"""Validators: conversations, rewritten targets, delivered outputs, reviews, stored rows; each gives reasons as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import forms, udfs
from ..functions import text as tx

# The patterns whose matches reject a conversation.
THINK_TAGS = r"(?i)</?think>|</?analysis>"
CHAT_MARKERS = r"(?i)<tool_(?:call|response)>|<\|im_(?:start|end)\|>"
EMBEDDED_ASSISTANT = r"(?i)(?:^|\n)\s*(?:assistant|助手|助理)\s*(?::|：|\n)"
UNEXPECTED_SCRIPT = r"[\x{0400}-\x{04ff}\x{0600}-\x{06ff}\x{0e00}-\x{0e7f}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}\x{fb50}-\x{fdff}]"
REPEATED_LATIN = r"(?i)\b([A-Za-z]{3,})\b(?:\s+\1){3,}"
GOAL_LEAK = r"(?i)(?:^|[\s，。！？])goal(?:[!\s，。！？]|$)"
TEMPLATE_ARTIFACT = (
    r"(?i)_measurement|_(?:fieldName|value)\d*|GetUserProblemByUid|parentId|divisbble|(?<=[\x{3400}-\x{9fff}])\s+intersections\s+(?=[\x{3400}-\x{9fff}])"
    r"|(?:^|\n)\s*(?:disgusting|horrible|terrible)\s+merger\b|(?:不相关|无关)(?:的)?(?:主题|内容).{0,24}(?:忽略|无视)|(?:忽略|无视).{0,24}(?:不相关|无关)(?:的)?(?:主题|内容)"
)
MODEL_IDENTITY = r"(?i)(?:作为|身为).{0,12}(?:AI|人工智能|语言模型)|(?:我是|我只是|我虽然是).{0,8}(?:AI|人工智能|语言模型)|我(?:并)?没有(?:真实的)?(?:感情|情感)|开源语言模型"
CONTROL = r"[\x00-\x08\x0b-\x1f]"
# What a rewritten target must keep.
NUMBER = r"\p{Nd}+(?:[.,，．]\p{Nd}+)*(?:[%％])?"
LATIN_TERM = r"[A-Za-z]+(?:[._-][A-Za-z]+)*"
PROTECTED = (("book", "《([^《》]*)》"), ("quote", "“([^“”]*)”"), ("quote", "「([^「」]*)」"), ("quote", "『([^『』]*)』"), ("bracket", "【([^【】]*)】"), ("bracket", r"\(([^()]*)\)"), ("bracket", "（([^（）]*)）"))
SCOPE = (
    "并没有|不再|不得|不能|不会|尚未|并非|没有|至少|至多|不超过|不少于|不低于|超过|低于|高于|可能|也许|或许|大约|预计|有望|应当|应该|必须|再次|仍然|仍旧|持续|进一步|明确|甚至|可以说|也"
)
BREAK = "[。！？!?;；]"


def structural_reason(messages: Column, least: int = 12, most: int = 12_000) -> Column:
    """The first structural fault of a conversation of (role, content); null if it has none or is null."""

    def judge(ms: Column) -> Column:
        said = F.filter(ms, lambda m: m["role"] != "system")
        roles = F.transform(said, lambda m: m["role"])
        turns = F.arrays_zip(F.slice(roles, 1, F.greatest(F.size(roles) - 1, F.lit(0))).alias("a"), F.slice(roles, 2, F.greatest(F.size(roles) - 1, F.lit(0))).alias("b"))
        sizes = F.transform(ms, lambda m: F.length(m["content"]))
        return (
            F.when(F.size(ms) < 2, "too_few_messages")
            .when(F.element_at(ms, -1)["role"] != "assistant", "does_not_end_assistant")
            .when(F.coalesce(F.try_element_at(roles, F.lit(1)), F.lit("")) != "user", "does_not_start_user")
            .when(F.exists(turns, lambda t: t["a"] == t["b"]), "roles_not_alternating")
            .when(F.aggregate(sizes, F.lit(0), lambda a, x: a + x) < least, "too_short")
            .when(F.exists(sizes, lambda x: x > most), "single_message_too_long")
        )

    return tx.let(messages, judge)


def filter_reason(messages: Column, source: Column, category: Column, tokens: Column, answer_tokens: Column, strict_source: str = "smoltalk_chinese", identity_source: str = "synthetic_identity_verified", most_tokens: int = 2048, least_tokens: int = 2) -> Column:
    """The first of eighteen reasons to leave a conversation out; null keeps it. Messages are taken as normalised.

    Rules against embedded answers, mixed scripts, leaked goals and template remains hold for ``strict_source`` only;
    what names the model is allowed in ``identity_source``. ``tokens`` and ``answer_tokens`` are the sizes of the whole
    transcript and of the answers in tokens of whatever tokenizer counts.
    """

    def judge(x: Column) -> Column:
        ms, strict = x["m"], F.coalesce(x["s"], F.lit("")) == strict_source
        said = lambda role=None: F.array_join(F.transform(ms if role is None else F.filter(ms, lambda m: m["role"] == role), lambda m: m["content"]), "\n")
        raw, like = said(), lambda t, p: F.regexp_like(t, F.lit(p))
        return F.coalesce(
            structural_reason(ms),
            F.when(like(raw, THINK_TAGS), "visible_think_tags")
            .when(like(raw, CHAT_MARKERS), "foreign_chat_marker")
            .when(strict & like(said("user"), EMBEDDED_ASSISTANT), "embedded_assistant_text")
            .when(strict & (F.coalesce(x["c"], F.lit("")) != "translate") & like(raw, UNEXPECTED_SCRIPT), "unexpected_script_mixing")
            .when(like(raw, REPEATED_LATIN), "repeated_latin_noise")
            .when(strict & (F.coalesce(x["c"], F.lit("")) == "everyday") & like(raw, GOAL_LEAK), "everyday_goal_leak")
            .when(strict & like(raw, TEMPLATE_ARTIFACT), "smoltalk_template_artifact")
            .when(F.contains(raw, F.lit("�")), "replacement_character")
            .when(like(raw, CONTROL), "control_character")
            .when((F.coalesce(x["s"], F.lit("")) != identity_source) & like(said("assistant"), MODEL_IDENTITY), "assistant_model_identity")
            .when(x["t"] > most_tokens, "over_max_tokens")
            .when(x["a"] < least_tokens, "assistant_too_short"),
        )

    return tx.let(F.struct(messages.alias("m"), source.alias("s"), category.alias("c"), tokens.alias("t"), answer_tokens.alias("a")), judge)


def signature(t: Column) -> Column:
    """Letters and digits alone, in their case."""
    return F.regexp_replace(t, r"[^\p{L}\p{N}]+", "")


def protected_spans(t: Column) -> Column:
    """What stands in quotes, titles and brackets, by kind, sorted."""

    def spans(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), lambda x: F.concat(F.lit(f"{kind}:"), signature(x)))

    return F.array_sort(F.concat(*(spans(k, p) for k, p in PROTECTED)))


def target_issue(source: Column, target: Column) -> Column:
    """The first thing that a rewritten target changed and mustn't; null if it kept all, or a text is null."""
    found = lambda t, p: F.array_sort(F.regexp_extract_all(t, F.lit(p), F.lit(0)))

    def judge(x: Column) -> Column:
        s, t = x["s"], x["t"]
        n, k = F.length(s), F.length(t)
        breaks = lambda c: F.regexp_count(c, F.lit(BREAK))
        return (
            F.when(s.isNull() | t.isNull(), None)
            .when(found(s, NUMBER) != found(t, NUMBER), "numbers_changed")
            .when(found(s, LATIN_TERM) != found(t, LATIN_TERM), "latin_terms_changed")
            .when(protected_spans(s) != protected_spans(t), "protected_text_changed")
            .when(found(s, SCOPE) != found(t, SCOPE), "scope_terms_changed")
            .when((s != t) & (signature(s) == signature(t)) & ((n < 40) | (breaks(t) <= breaks(s))), "only_marks_changed")
            .when((s != t) & (n >= 20) & (k < n * 0.8), "too_much_removed")
            .when((s != t) & (k > F.greatest(n + 8, F.floor(n * 1.05))), "too_long")
        )

    return tx.let(F.struct(source.alias("s"), target.alias("t")), judge)


def output_issues(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """(key, code): errors of delivered outputs (place, key, decision, target) against inputs (place, key, source).

    Rows meet by place. An input without output is missing_output, an output without input extra_output; the other
    codes are key_or_order_mismatch, invalid_decision, empty_target, keep_changed_text, simplified_is_identity and
    number_mismatch. Null decisions and targets count as empty.
    """
    i = inputs.select("place", F.col("key").alias("_k"), "source", F.lit(True).alias("_in"))
    o = outputs.select("place", "key", F.coalesce("decision", F.lit("")).alias("decision"), F.coalesce("target", F.lit("")).alias("target"), F.lit(True).alias("_out"))
    own = i.join(o, "place", "full_outer")
    when = lambda c, name: F.when(c, F.lit(name))
    both = F.col("_in").isNotNull() & F.col("_out").isNotNull()
    s, t = F.coalesce("source", F.lit("")), F.col("target")
    codes = F.array(
        when(F.col("_out").isNull(), "missing_output"),
        when(F.col("_in").isNull(), "extra_output"),
        when(both & ~F.col("key").eqNullSafe(F.col("_k")), "key_or_order_mismatch"),
        when(both & ~F.col("decision").isin("keep", "simplified"), "invalid_decision"),
        when(both & (tx.strip(t) == ""), "empty_target"),
        when(both & (F.col("decision") == "keep") & (t != s), "keep_changed_text"),
        when(both & (F.col("decision") == "simplified") & (t == s), "simplified_is_identity"),
        when(both & (F.col("decision") == "simplified") & ~tx.same_multiset(tx.numbers(s, tx.NUMBER_SPAN), tx.numbers(t, tx.NUMBER_SPAN)), "number_mismatch"),
    )
    return own.select(F.coalesce("_k", "key").alias("key"), F.explode(F.array_compact(codes)).alias("code"))


def surface_reverts(rows: DataFrame, fold: bool = True) -> DataFrame:
    """Rows (source, target, decision) where a change of marks and blanks alone is taken back: the target is the source
    again, the decision ``keep``, and ``reverted`` says so. ``fold`` compares with compatibility forms folded."""
    form = lambda c: tx.surface(udfs.nfkc(F.col(c)) if fold else F.col(c))
    back = F.coalesce((F.col("decision") == "simplified") & (F.col("source") != F.col("target")) & (form("source") == form("target")), F.lit(False))
    own = rows.withColumn("reverted", back)
    return own.withColumns({"target": F.when(F.col("reverted"), F.col("source")).otherwise(F.col("target")), "decision": F.when(F.col("reverted"), "keep").otherwise(F.col("decision"))})


def review_issue(decision: Column, target: Column, source: Column, candidate: Column) -> Column:
    """What is wrong with a review of a candidate; null for a valid one."""
    t = F.coalesce(target, F.lit(""))
    return (
        F.when(~F.coalesce(decision, F.lit("")).isin("accept", "revert", "revise") | (tx.strip(t) == ""), "invalid_decision_or_target")
        .when((decision == "accept") & ~t.eqNullSafe(candidate), "accept_differs_from_candidate")
        .when((decision == "revert") & ~t.eqNullSafe(source), "revert_differs_from_source")
        .when((decision == "revise") & t.eqNullSafe(source), "revision_equals_source")
        .when((decision == "revise") & ~tx.same_multiset(tx.numbers(source, tx.NUMBER_SPAN), tx.numbers(t, tx.NUMBER_SPAN)), "revision_changes_numbers")
    )


def apply_reviews(outputs: DataFrame, reviews: DataFrame) -> DataFrame:
    """Outputs (key, decision, target, ...) with the target of their review; a revert keeps, the others simplify.

    Reviews (key, decision, target) hold one row a key; a review without its output is an error.
    """
    r = reviews.select("key", F.col("decision").alias("_d"), F.col("target").alias("_t"))
    lost = r.join(outputs.select("key"), "key", "left_anti").select("key").head(1)
    if lost:
        raise KeyError(f"no output for the review of {lost[0][0]}")
    own = outputs.join(r, "key", "left")
    kept = F.when(F.col("_d") == "revert", "keep").when(F.col("_d").isNotNull(), "simplified").otherwise(F.col("decision"))
    return own.withColumns({"decision": kept, "target": F.coalesce("_t", "target"), "reviewed": F.col("_d").isNotNull()}).drop("_d", "_t")


def expected_match(output: Column, expected: Column) -> Column:
    """(exact, contains): whether an answer is, or holds, one of the accepted answers; null where none is given."""
    own = F.filter(F.transform(expected, tx.answer_form), lambda x: x.isNotNull())
    some = F.filter(expected, lambda x: tx.strip(x) != "")
    o = tx.answer_form(output)
    return F.when(F.size(some) > 0, F.struct(F.array_contains(own, o).alias("exact"), F.exists(own, lambda x: F.contains(o, x)).alias("contains")))


def is_json_object(t: Column) -> Column:
    """The text is one JSON object, blanks around it aside; false for null."""
    kind = F.schema_of_variant(F.try_parse_json(tx.strip(t)))
    return F.coalesce(F.startswith(kind, F.lit("OBJECT")), F.lit(False))


def three_items(t: Column) -> Column:
    """The first line holds exactly three items between commas, none over twelve characters."""
    line = F.element_at(F.split(F.concat(tx.strip(F.coalesce(t, F.lit(""))), F.lit("\n")), r"[\n\r]"), 1)
    items = F.filter(F.transform(F.split(line, "[，,、]"), tx.strip), lambda x: x != "")
    return tx.let(items, lambda x: (F.size(x) == 3) & F.forall(x, lambda i: F.length(i) <= 12))


def row_errors(messages: Column, num_tokens: Column, most: int = 2048) -> Column:
    """All errors of a stored conversation, in a fixed order: invalid_messages alone, else boundary roles, turns, size."""

    def judge(x: Column) -> Column:
        roles = F.filter(F.transform(x["m"], lambda m: m["role"]), lambda r: r != "system")
        turns = F.exists(F.sequence(F.lit(2), F.greatest(F.size(roles), F.lit(2))), lambda i: F.try_element_at(roles, i).eqNullSafe(F.try_element_at(roles, i - 1)) & (i <= F.size(roles)))
        edge = ~(F.try_element_at(roles, F.lit(1)).eqNullSafe("user") & F.try_element_at(roles, F.lit(-1)).eqNullSafe("assistant"))
        more = F.array(F.when(edge, F.lit("invalid_boundary_roles")), F.when(turns, F.lit("roles_not_alternating")), F.when(x["n"] > most, F.lit("too_many_tokens")))
        return F.when(F.coalesce(F.size(x["m"]), F.lit(0)) < 2, F.array(F.lit("invalid_messages"))).otherwise(F.array_compact(more))

    return tx.let(F.struct(messages.alias("m"), F.coalesce(num_tokens, F.lit(0)).alias("n")), judge)


def bundle_report(docs: DataFrame, text_col: str, least: int) -> DataFrame:
    """One row on a bundle of texts: documents, nulls, blanks, too short ones, duplicates, and their lengths."""
    t = F.col(text_col)
    part = docs.groupBy(F.sha2(t, 256).alias("_h")).agg(
        F.count("*").alias("n"), F.first(t.isNull()).alias("null"), F.first(tx.strip(t) == "").alias("blank"), F.first(F.length(t)).alias("size")
    )  # copies are one row from here on
    n, some = F.col("n"), ~F.col("null")
    return part.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("documents"), F.coalesce(F.sum(F.when(F.col("null"), n)), F.lit(0)).alias("nulls"), F.coalesce(F.sum(F.when(F.col("blank"), n)), F.lit(0)).alias("blanks"),
        F.coalesce(F.sum(F.when(F.col("size") < least, n)), F.lit(0)).alias("too_short"), F.coalesce(F.sum(F.when(some, n - 1)), F.lit(0)).alias("duplicates"),
        F.min("size").alias("min_chars"), F.max("size").alias("max_chars"), F.round(F.sum(F.col("size") * n) / F.sum(F.when(some, n)), 4).alias("mean_chars"),
    )


def union_state(base: DataFrame, extension: DataFrame, full: DataFrame, key: str = "file") -> DataFrame:
    """(key, state) of everything that keeps ``full`` from being the disjoint union of base and extension: in_both,
    missing_in_full or only_in_full. No row: it is one."""
    tag = lambda df, c: df.select(key).filter(F.col(key).isNotNull()).distinct().withColumn(c, F.lit(True))
    own = tag(base, "_b").join(tag(extension, "_e"), key, "full_outer").join(tag(full, "_f"), key, "full_outer")
    part = F.col("_b").isNotNull() | F.col("_e").isNotNull()
    state = F.when(F.col("_b") & F.col("_e"), "in_both").when(part & F.col("_f").isNull(), "missing_in_full").when(~part, "only_in_full")
    return own.select(key, state.alias("state")).filter("state is not null")


def resume_state(done: DataFrame, wanted: DataFrame) -> DataFrame:
    """(place, state) of what keeps rows done (place, source, target) from being a prefix of the rows wanted (place,
    source): beyond_input, source_differs or invalid_target. No row: the run can go on behind its last row."""
    d = done.select("place", F.col("source").alias("_s"), F.col("target").alias("_t"), F.lit(True).alias("_d"))
    w = wanted.select("place", "source", F.lit(True).alias("_w"))
    own = d.join(w, "place", "left")
    state = F.when(F.col("_w").isNull(), "beyond_input").when(~F.col("_s").eqNullSafe(F.col("source")), "source_differs").when(F.coalesce("_t", F.lit("")) == "", "invalid_target")
    return own.select("place", state.alias("state")).filter("state is not null")


def curated_chinese(prompt: Column, answer: Column) -> Column:
    """A Chinese instruction worth keeping: enough Han, little Latin, no remains of translated tasks, not too long."""
    both = F.concat(prompt, F.lit("\n"), answer)
    han, latin = F.regexp_count(both, F.lit(r"[\x{3400}-\x{9fff}]")), F.regexp_count(both, F.lit("[A-Za-z]"))
    choice = F.regexp_like(answer, F.lit(r"^\s*[A-Da-d]\s*[)）.、:：]")) & (F.regexp_count(prompt, F.lit(r"(?:^|\n)\s*[A-Da-d]\s*[)）.、:：]")) < 2)
    translated = F.regexp_like(prompt, F.lit("^(?:在这个任务中|在这项任务中|在本任务中|你会得到|你将得到|给定一组)"))
    return (han >= 12) & (latin <= F.greatest(F.lit(24), F.floor(han * 0.25))) & ~translated & ~choice & (F.length(prompt) <= 1200) & (F.length(answer) <= 1600)


# Bans on instruction data, in the order in which they are looked at.
BANS = {
    "identity": r"(?iU)\b(?:ChatGPT|OpenAI|Claude|Gemini|Llama)\b|\bas an AI\b|\bas a language model\b|我是(?:ChatGPT|Claude|Gemini)|作为(?:一个)?(?:AI|人工智能|语言模型)",
    "high_stakes": (
        r"(?iU)\b(?:diagnos(?:e|is)|dosage|prescription|medical advice|legal advice|investment advice|stock recommendation|latest|today|current president|current law|breaking news)\b"
        r"|诊断|处方|剂量|服药|医疗建议|法律建议|投资建议|股票推荐|最新消息|今天的新闻|现任总统|现行法律"
    ),
    "harmful": (
        r"(?iU)\b(?:ransomware|keylogger|credential theft|steal passwords|phishing kit|make a bomb|build a bomb|poison someone|evade law enforcement|swiss army knife|throwing knife|knife throwing|criminal suspect|profile a suspect)\b"
        r"|勒索软件|键盘记录器|窃取密码|钓鱼网站|制作炸弹|制造炸弹|投毒|逃避执法|瑞士军刀|飞刀|投掷.{0,10}(?:刀|军刀)|犯罪嫌疑人|刑事侦查|犯罪画像"
    ),
    "artifact": r"(?m)<\|im_(?:start|end)\|>|<tool_(?:call|response)>|<<[^<>\n]{1,120}>>|^\s*####\s*",
    "benchmark": r"(?iU)\b(?:MMLU|GSM8K|HumanEval|MBPP|AlpacaEval|MT-Bench|Arena-Hard)\b",
}
ADVICE = "诊断|治疗|药物|处方|剂量|服用|手术|怀孕|孕期|症状|股票|投资|诉讼|法律意见"


def ban_reason(t: Column) -> Column:
    """The first ban that a text falls under; null for none."""
    return forms.pattern_reason(t, BANS)


def reply_approved(message: Column, role: str) -> Column:
    """Whether a reviewed message may stand in a path: (role, lang, deleted, review_result, text, rank, review_count,
    labels map of (value, count)). Answers need the best rank, two reviews, low risk labels and fair quality."""
    label = lambda n: F.coalesce(message["labels"][n], F.struct(F.lit(0.0).alias("value"), F.lit(0).alias("count")))
    plain = (message["role"] == role) & (message["lang"] == "zh") & ~F.coalesce(message["deleted"], F.lit(False)) & F.coalesce(message["review_result"], F.lit(True)) & (tx.chat_text(message["text"]) != "")
    if role != "assistant":
        return F.coalesce(plain, F.lit(False))
    safe = F.lit(True)
    for n in ("spam", "fails_task", "lang_mismatch", "pii", "not_appropriate", "hate_speech", "sexual_content", "toxicity", "violence"):
        safe = safe & ~((F.coalesce(label(n)["count"], F.lit(0)) > 0) & (F.coalesce(label(n)["value"], F.lit(0.0)) > 0.1))
    for n in ("quality", "helpfulness"):
        safe = safe & ~((F.coalesce(label(n)["count"], F.lit(0)) >= 2) & (F.coalesce(label(n)["value"], F.lit(0.0)) < 0.5))
    return F.coalesce(plain & (F.coalesce(message["rank"], F.lit(0)) == 0) & (F.coalesce(message["review_count"], F.lit(0)) >= 2) & safe, F.lit(False))
