"""Readers of public instruction sets: rows as their files hold them become conversations of one form.

Each takes the rows of a set (``numbered`` gives rows of line files their number) and returns
(messages, source, category, group_id, source_id); rows that the set's own rules leave out have no row.
"""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import forms, udfs
from ..functions import text as tx
from ..operators import validation
from ..session import materialize

# Role names by alias.
ROLES = {"human": "user", "prompter": "user", "usr": "user", "user": "user", "assistant": "assistant", "gpt": "assistant", "bot": "assistant", "sys": "assistant", "system": "system"}


def find_files(spark: SparkSession, paths: list[str], kinds: tuple[str, ...] = (".txt", ".jsonl")) -> list[str]:
    """Files of the given kinds by name, glob or folder (searched through), each once, sorted; none is an error."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found: set[str] = set()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        for status in fs.globStatus(path) or []:
            if status.isFile():
                found.add(status.getPath().toString())
                continue
            inside = fs.listFiles(status.getPath(), True)
            while inside.hasNext():
                found.add(inside.next().getPath().toString())
    out = sorted(f for f in found if f.lower().endswith(kinds))
    if not out:
        raise FileNotFoundError(f"no {' or '.join(kinds)} file in {paths}")
    return out


def numbered(df: DataFrame, name: str = "number") -> DataFrame:
    """The rows with their place (from 1) in the order in which the files hold them. Counts per task are summed first."""
    own = df.withColumn("_i", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_i", 33)).withColumn("_k", F.col("_i").bitwiseAND(F.lit((1 << 33) - 1)))
    sums = own.groupBy("_p").agg(F.count("*").alias("_n"))  # one row a task
    before = sums.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return own.join(F.broadcast(before), "_p").withColumn(name, F.col("_b") + F.col("_k") + 1).drop("_i", "_p", "_k", "_b")


def field_text(c: Column, kind: str) -> Column:
    """A field as text: null is empty, lists are put together (nested ones too), other values in their own notation."""
    if kind.startswith("array<"):
        inner = kind[6:-1]
        return F.coalesce(F.array_join(F.transform(c, lambda x: field_text(x, inner)), ""), F.lit(""))
    return F.coalesce(c.cast("string"), F.lit(""))


def plain_messages(messages: Column, role: str = "role", content: str = "content") -> Column:
    """Roles by their aliases and contents normalised; messages of unknown roles or without content go."""
    alias = F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))
    plain = F.transform(messages, lambda m: F.struct(alias[F.lower(F.trim(m[role]))].alias("role"), tx.chat_text(m[content]).alias("content")))
    return F.coalesce(F.filter(plain, lambda m: m["role"].isNotNull() & (m["content"] != "")), F.array().cast("array<struct<role:string,content:string>>"))


def said(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def records(df: DataFrame, messages: Column, source: str | Column, category: str | Column, source_id: Column, group: Column | None = None) -> DataFrame:
    s, c = (F.lit(x) if isinstance(x, str) else x for x in (source, category))
    key = source_id.cast("string")
    return df.select(messages.alias("messages"), s.alias("source"), c.alias("category"), (F.concat(s, F.lit(":"), key) if group is None else group).alias("group_id"), key.alias("source_id"))


def pair_records(df: DataFrame, instruction: Column, context: Column, answer: Column, source: str, category: str | Column, source_id: Column) -> DataFrame:
    """Instruction and context as one question, the answer; rows without either are left out."""
    ask, more, reply = (tx.chat_text(c) for c in (instruction, context, answer))
    prompt = F.when(more == "", ask).when(ask == "", more).otherwise(F.concat(ask, F.lit("\n\n"), more))
    own = df.withColumns({"_q": prompt, "_a": reply}).filter("_q <> '' and _a <> ''")
    return records(own, F.array(said("user", F.col("_q")), said("assistant", F.col("_a"))), source, category, source_id)


def smoltalk(df: DataFrame, category: str) -> DataFrame:
    """Rows (number, conversations of (role, content), score if there is one) with a score of at least 4."""
    own = df.filter(F.coalesce(F.col("score").cast("int"), F.lit(0)) >= 4) if "score" in df.columns else df
    own = own.withColumn("_m", plain_messages(F.col("conversations"))).filter(F.size("_m") > 0)
    key = F.concat(F.lit(f"{category}:"), F.col("number").cast("string"))
    return records(own, F.col("_m"), "smoltalk_chinese", category, key, F.concat(F.lit("smoltalk:"), key))


def coig(df: DataFrame) -> DataFrame:
    """Rows (number, instruction, input, output, task_type of minor, an array); the first minor type is the category."""
    ask, more, reply = (tx.chat_text(c) for c in ("instruction", "input", "output"))
    prompt = F.when(more == "", ask).when(ask == "", more).otherwise(F.concat(ask, F.lit("\n\n"), more))
    kind = F.coalesce(F.try_element_at(F.col("task_type")["minor"], F.lit(1)), F.lit("general"))
    return records(df, F.array(said("user", prompt), said("assistant", reply)), "coig_cqia", kind, F.col("number"), F.concat(F.lit("coig:"), F.col("number").cast("string")))


def flexible(df: DataFrame, domain: str) -> DataFrame:
    """Rows (source_id and any of messages, conversations, instruction/prompt/query, output/response/answer): the first
    list that is there, else question and answer under whichever name holds them."""
    first = lambda *names: F.coalesce(*(F.col(n) for n in names if n in df.columns), F.lit(""))
    asked = plain_messages(F.array(said("user", first("instruction", "prompt", "query")), said("assistant", first("output", "response", "answer"))))
    lists = [F.when(F.col(n).isNotNull(), plain_messages(F.col(n))) for n in ("messages", "conversations") if n in df.columns]
    return records(df, F.coalesce(*lists, asked), f"ultradata_{domain}", domain, F.col("source_id"), F.concat(F.lit(f"ultradata:{domain}:"), F.col("source_id").cast("string")))


def reply_tree_paths(df: DataFrame, most: int = 2) -> DataFrame:
    """Rows (message_id, parent_id, text, role, lang, review_result, deleted, rank, review_count, message_tree_id): of each
    tree the ``most`` best paths from the root to an answer: the longest, then by rank less reviews, then by id.

    Only Chinese messages that are neither deleted nor rejected count; a path with a gap doesn't. All trees grow at
    once by one message a round, as many rounds as the longest path has messages.
    """
    own = df.filter((F.col("lang") == "zh") & ~F.coalesce("deleted", F.lit(False)) & F.coalesce("review_result", F.lit(True)))
    node = own.select("message_id", "parent_id", "message_tree_id", "role", "text", "rank", "review_count")
    front = node.filter("coalesce(cast(parent_id as string), '') = ''").select("message_id", "message_tree_id", "role", "rank", "review_count", F.array(F.struct("role", F.col("text").alias("content"))).alias("path"))
    found = None
    while True:
        front = materialize(front, "paths")
        found = front if found is None else found.unionByName(front)
        if not front.head(1):
            break
        below = node.select(F.col("parent_id").alias("_up"), F.col("message_id").alias("_id"), F.col("role").alias("_r"), "text", F.col("rank").alias("_rank"), F.col("review_count").alias("_n"))
        front = front.join(below, front.message_id == below._up).select(
            F.col("_id").alias("message_id"), "message_tree_id", F.col("_r").alias("role"), F.col("_rank").alias("rank"), F.col("_n").alias("review_count"), F.concat("path", F.array(F.struct(F.col("_r").alias("role"), F.col("text").alias("content")))).alias("path")
        )
    ends = found.filter("role = 'assistant'").withColumn("messages", plain_messages(F.col("path")))
    order = Window.partitionBy("message_tree_id").orderBy(F.size("messages").desc(), F.coalesce(F.col("rank"), F.lit(1_000_000)) - F.coalesce(F.col("review_count"), F.lit(0)), "message_id")
    best = ends.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most)
    return records(best, F.col("messages"), "oasst2_zh", "assistant_dialogue", F.col("message_id"), F.concat(F.lit("oasst2:"), F.col("message_tree_id").cast("string")))


def worked_answer(c: Column) -> Column:
    """A worked answer with its calculator notes written out and its final line named."""
    t = F.regexp_replace(tx.chat_text(c), r"<<([^=<>]+)=([^<>]+)>>\s*\2", "$1 = $2")
    t = tx.let(t, lambda x: F.array_join(F.transform(F.split(F.regexp_replace(x, "<<([^<>]+)>>", "\x01$1\x01"), "\x01"), lambda p, i: F.when(i % 2 == 1, F.replace(p, F.lit("="), F.lit(" = "))).otherwise(p)), ""))
    return F.regexp_replace(t, r"####\s*([^\n]+)", "答案：$1")


def gsm8k(df: DataFrame) -> DataFrame:
    """Rows (number, question_zh, answer_zh, split if there is one) of the training part."""
    own = df.filter(F.lower(F.coalesce("split", F.lit("train"))) == "train") if "split" in df.columns else df
    return pair_records(own, F.col("question_zh"), F.lit(""), worked_answer(F.col("answer_zh")), "gsm8k_zh", "arithmetic_reasoning", F.col("number"))


def translated_instructions(df: DataFrame) -> DataFrame:
    """Rows (number, trans_instruction, trans_input, trans_output) that pass for curated Chinese instructions."""
    ask, more, reply = (tx.chat_text(f"trans_{c}") for c in ("instruction", "input", "output"))
    prompt = F.when(more == "", ask).otherwise(F.concat(ask, F.lit("\n\n"), more))
    own = df.filter(validation.curated_chinese(prompt, reply))
    return pair_records(own, F.col("trans_instruction"), F.col("trans_input"), F.col("trans_output"), "coig_translated_verified", "general_instruction", F.col("number"))


def human_values(df: DataFrame) -> DataFrame:
    """Rows (number, instruction, input, output)."""
    return pair_records(df, F.col("instruction"), F.col("input"), F.col("output"), "coig_human_value", "human_value_alignment", F.col("number"))


def _literal_list(text: str) -> str:
    at = text.find("[")
    if at < 0:
        return text
    try:
        got = ast.literal_eval(text[at:])
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        return text
    if not isinstance(got, list) or not got or not all(isinstance(x, str) for x in got):
        return text
    head, body = text[:at].rstrip(), "\n\n".join(x.strip() for x in got)
    return f"{head}\n{body}" if head else body


@F.pandas_udf(T.StringType())
def literal_list(texts: pd.Series) -> pd.Series:
    """Texts that end in a list of strings as source code writes it: what stands before, and the strings as paragraphs."""
    return texts.map(_literal_list, na_action="ignore")


def leetcode(df: DataFrame) -> DataFrame:
    """Rows (number, instruction, input, output, task_type), whose fields may be lists in source notation."""
    kind = F.concat(F.lit("code_"), F.when(tx.chat_text("task_type") == "", "code").otherwise(tx.chat_text("task_type")))
    return pair_records(df, F.col("instruction"), literal_list(tx.chat_text("input")), literal_list(tx.chat_text("output")), "coig_leetcode", kind, F.col("number"))


def fenced_json(c: Column, schema: str) -> Column:
    """A JSON object, with or without a code fence around it; null if there is none."""
    t = tx.chat_text(c)
    bare = F.when(F.startswith(t, F.lit("```")), F.regexp_replace(t, r"(?i)^```(?:json)?\s*|\s*```$", "")).otherwise(t)
    return F.when(validation.is_json_object(bare), F.from_json(bare, schema))


def correction_rounds(df: DataFrame) -> DataFrame:
    """Rows (source_id, responses, an array of texts): rounds of question and answer as JSON objects (Q, A), fenced or
    not; the first five rounds count, broken or empty ones are passed over, and two rounds must be left."""
    got = F.transform(F.slice("responses", 1, 5), lambda r: fenced_json(r, "Q string, A string"))
    turns = F.transform(got, lambda x: F.array(said("user", tx.chat_text(x["Q"])), said("assistant", tx.chat_text(x["A"]))))
    kept = F.filter(turns, lambda t: (t[0]["content"] != "") & (t[1]["content"] != ""))
    own = df.withColumn("_m", F.flatten(kept)).filter(F.size("_m") >= 4)
    return records(own, F.col("_m"), "coig_counterfactual", "factual_correction_dialogue", F.col("source_id"))


def reading(df: DataFrame, source: str, category: str = "reading_comprehension") -> DataFrame:
    """Rows (id, context, question, answers, an array): the first answer, which must stand in the context."""
    context, question = tx.chat_text("context"), tx.chat_text("question")
    answer = tx.chat_text(F.try_element_at(F.col("answers"), F.lit(1)))
    own = df.withColumns({"_c": context, "_q": question, "_a": answer}).filter("_c <> '' and _q <> '' and _a <> '' and contains(_c, _a)")
    return records(own, F.array(said("user", forms.reading_prompt(F.col("_c"), F.col("_q"))), said("assistant", F.col("_a"))), source, category, F.col("id"))


def robust_reading(df: DataFrame) -> DataFrame:
    """The same with the rules against noisy material: contexts of 80 characters and more without leftovers of
    forums and translators, questions of 4 to 160 characters, answers of at most 160."""
    noise = r"\\x0a|望采纳|请采纳|谢谢阅读|希望能够帮助|以下结果由|译典通|\|.{0,200}\|"
    c, q, a = tx.chat_text("context"), tx.chat_text("question"), tx.chat_text(F.try_element_at(F.col("answers"), F.lit(1)))
    own = df.filter((F.length(c) >= 80) & ~F.regexp_like(c, F.lit(noise)) & F.length(q).between(4, 160) & (F.length(a) <= 160))
    return reading(own, "dureader_robust", "reading_comprehension_robust")


def abilities(df: DataFrame, ability: str) -> DataFrame:
    """Rows (number, idx if there is one, messages) with at least two messages."""
    own = df.withColumn("_m", plain_messages(F.col("messages"))).filter(F.size("_m") >= 2)
    key = F.coalesce(F.col("idx").cast("string"), F.col("number").cast("string")) if "idx" in df.columns else F.col("number")
    return records(own, F.col("_m"), f"doit_{ability}", ability, key)


def constrained(df: DataFrame) -> DataFrame:
    """Rows (id, constraints, messages): one or two constraints, one question and one answer that keeps its plain
    demands, nothing that goes out of date or where advice is risky."""
    ms = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), tx.chat_text(m["content"]).alias("content")))
    own = df.withColumn("_m", ms).filter(F.size("constraints").between(1, 2) & (F.size("_m") == 2))
    own = own.filter((F.col("_m")[0]["role"] == "user") & (F.col("_m")[1]["role"] == "assistant"))
    both = F.concat(F.col("_m")[0]["content"], F.lit("\n"), F.col("_m")[1]["content"])
    own = own.filter(~F.regexp_like(both, F.lit(r"(?iU)\b(?:recent|current|latest|today|financial advice|medical advice|diagnos|treatment|dosage|lawsuit)\b")))
    own = own.filter(forms.obeys(F.col("_m")[0]["content"], F.col("_m")[1]["content"]))
    return records(own, F.col("_m"), "tulu_instruction_following", "strict_instruction_following_english", F.col("id"))


def language_tag(c: Column | str) -> Column:
    """zh and en for their variants, other tags in lower case with hyphens."""
    t = F.replace(F.lower(tx.chat_text(c)), F.lit("_"), F.lit("-"))
    return F.when(F.startswith(t, F.lit("zh")), "zh").when(F.startswith(t, F.lit("en")), "en").otherwise(t)


# Words of ability labels and the category they stand for, in order.
ABILITIES = (
    (("programming", "software development", "code"), "code_and_programming"), (("mathematical", "calculation", "arithmetic"), "mathematical_reasoning"), (("logic", "reasoning"), "logical_reasoning"), (("creativity", "creative writing"), "creative_writing"),
    (("humanities", "history", "philosophy", "sociology"), "humanities_knowledge"), (("data science", "data analysis", "analytics"), "data_analysis"), (("information processing", "knowledge", "fact checking"), "knowledge_qa"), (("problem solving", "support", "planning"), "planning_advice"),
    (("writing", "language", "translation"), "writing_revision"),
)


def ability_category(terms: Column) -> Column:
    """The category of a text of ability labels, by the first group with a word in it."""
    t = F.lower(F.coalesce(terms, F.lit("")))
    out = F.lit("general_instruction")
    for words, name in reversed(ABILITIES):
        hit = F.contains(t, F.lit(words[0]))
        for w in words[1:]:
            hit = hit | F.contains(t, F.lit(w))
        out = F.when(hit, name).otherwise(out)
    return out


def infinity(df: DataFrame, key: str, subset: str, language: str, least_reward: float, allowed: list[str] | None = None) -> DataFrame:
    """Rows (id, conversations of (from, value), label of cate_ability_en and ability_en, langdetect, source, reward) of one
    language and, if given, of the allowed sources, with at least the reward, turns that alternate up to an answer, and
    nothing banned. A conversation with an unknown role or an empty message is left out whole."""
    own = df.filter((language_tag("langdetect") == language) & (F.col("reward").cast("double") >= least_reward) & ~F.isnan(F.col("reward").cast("double")) & (F.abs(F.col("reward").cast("double")) < float("inf")))
    if allowed:
        own = own.filter(tx.chat_text("source").isin(*allowed))
    own = own.withColumn("_m", plain_messages(F.col("conversations"), "from", "value")).filter(F.size("_m") == F.size("conversations"))
    said_roles = F.filter(F.transform("_m", lambda m: m["role"]), lambda r: r != "system")
    turns = tx.let(said_roles, lambda r: (F.size(r) >= 2) & (r[0] == "user") & (F.element_at(r, -1) == "assistant") & F.forall(F.sequence(F.lit(1), F.greatest(F.size(r) - 1, F.lit(1))), lambda i: F.get(r, i) != F.get(r, i - 1)))
    own = own.filter(turns)
    text = lambda role=None: F.array_join(F.transform(F.col("_m") if role is None else F.filter("_m", lambda m: m["role"] == role), lambda m: m["content"]), "\n")
    bad = F.regexp_like(text("assistant"), F.lit(validation.BANS["identity"]))
    for name, p in validation.BANS.items():
        bad = bad | F.regexp_like(text(), F.lit(p)) if name != "identity" else bad
    terms = F.array_join(F.concat(F.coalesce(F.col("label")["cate_ability_en"], F.array().cast("array<string>")), F.coalesce(F.col("label")["ability_en"], F.array().cast("array<string>"))), " ")
    source_id = F.concat(F.lit(f"{subset}:"), tx.chat_text("id"))
    return records(own.filter(~bad), F.col("_m"), f"{key}_{language}", ability_category(terms), source_id, F.concat(F.lit(f"{key}:"), source_id))


def log_values(lines: DataFrame, pattern: str, names: list[str], text_col: str = "value") -> DataFrame:
    """The groups of a pattern in the lines of a log that match it, as doubles, in the order of the log (``number``)."""
    own = numbered(lines).filter(F.regexp_like(text_col, F.lit(pattern)))
    return own.select("number", *(F.regexp_extract(text_col, pattern, i + 1).try_cast("double").alias(n) for i, n in enumerate(names)))


def folded_form(c: Column | str) -> Column:
    """For audits: compatibility forms folded, lower case, no blanks, marks or symbols."""
    return F.regexp_replace(F.lower(udfs.nfkc(tx.col(c))), r"[\s\p{Z}\x{1c}-\x{1f}\x{85}\p{P}\p{S}]+", "")
