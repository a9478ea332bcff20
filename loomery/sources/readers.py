"""Readers: Parquet with provenance, JSON lines (tolerant, strict), text, archives, nested sets, chats."""

from __future__ import annotations

import io
import json
import tarfile
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx

MESSAGES = "array<struct<role string, content string>>"
LAYOUT = "text string, instruction string, prompt string, query string, input string, output string, response string, answer string, messages array<struct<role string, content string>>, conversations array<struct<from string, value string>>, id string, source string, category string"


def parquet_records(spark: SparkSession, path: str, text: str = "text", source: str = "source", score: str = "score") -> DataFrame:
    """(text, source, score, source_file, source_row) of texts that aren't null; a missing column is an error by name.

    A null or empty source is ``unknown``; a score that is no number counts as minus infinity.
    """
    df = spark.read.parquet(path)
    gone = [c for c in (text, source, score) if c not in df.columns]
    if gone:
        raise KeyError(f"columns {gone} are missing in {path}")
    value = F.coalesce(F.col(score).try_cast("double"), F.lit(float("-inf")))
    named = F.when(F.coalesce(F.col(source).cast("string"), F.lit("")) == "", "unknown").otherwise(F.col(source).cast("string"))
    return df.select(F.col(text).cast("string").alias("text"), named.alias("source"), value.alias("score"), F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.row_index").alias("source_row")).filter("text is not null")


def jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON objects, one a line. Tolerant: ``reason`` says what is wrong (blank_line, invalid_json, not_an_object)
    and the fields are null. Strict: reading fails at the first bad line that isn't blank. A byte order mark is skipped.
    """
    line = F.regexp_replace("value", "^\\x{feff}", "")
    raw = spark.read.text(path).select(line.alias("line"), F.col("_metadata.file_name").alias("source_file"))
    parsed = F.try_parse_json(F.col("line"))
    blank = F.trim("line") == ""
    reason = F.when(blank, "blank_line").when(parsed.isNull(), "invalid_json").when(~F.startswith(F.ltrim("line"), F.lit("{")), "not_an_object")
    own = raw.withColumn("reason", reason)
    if strict:
        bad = F.col("reason").isNotNull() & (F.col("reason") != "blank_line")
        own = own.filter(~blank).filter(F.assert_true(~bad, F.concat(F.lit("bad line in "), "source_file", F.lit(": "), F.substring("line", 1, 80))).isNull())
    fields = F.from_json(F.when(F.col("reason").isNull(), F.col("line")), schema)
    return own.withColumn("_f", fields).select("_f.*", "source_file", "reason")


def text_units(spark: SparkSession, path: str, unit: str = "line") -> DataFrame:
    """(text, source_file) by line, paragraph between blank lines, or document; blank units are left out."""
    raw = spark.read.text(path, wholetext=unit != "line").select(F.col("value").alias("text"), F.col("_metadata.file_name").alias("source_file"))
    if unit == "blankline":
        raw = raw.select(F.explode(F.split("text", r"\r?\n[ \t]*\r?\n")).alias("text"), "source_file")
    return raw.withColumn("text", tx.strip("text")).filter("text <> ''")


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a file that holds an array, or an object with exactly one array field."""
    raw = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    fields = F.from_json(F.to_json(F.col("v")), "map<string,string>")
    arrays = F.filter(F.map_values(fields), lambda x: F.startswith(F.ltrim(x), F.lit("[")))
    top = F.startswith(F.ltrim(F.to_json("v")), F.lit("["))
    body = F.when(top, F.to_json("v")).when(F.size(arrays) == 1, F.element_at(arrays, 1))
    checked = raw.select(body.alias("b")).filter(F.assert_true(F.col("b").isNotNull(), F.lit("neither an array nor an object with one array")).isNull())
    return checked.select(F.explode(F.from_json("b", f"array<struct<{', '.join(_colon(schema))}>>")).alias("r")).select("r.*")


def _colon(schema: str) -> list[str]:
    return [f"{a}: {b}" for a, b in (x.strip().split(" ", 1) for x in schema.split(","))]


def layout_text(df: DataFrame) -> Column:
    """The text of a record in any of three layouts: text, instruction with input and output, messages."""
    ask = F.coalesce("instruction", "prompt", "query")
    more = F.when(F.coalesce(F.col("input"), F.lit("")) != "", F.concat(F.lit("\n"), "input")).otherwise("")
    reply = F.coalesce("output", "response", "answer")
    said = F.coalesce("messages", F.transform("conversations", lambda m: F.struct(m["from"].alias("role"), m["value"].alias("content"))))
    return F.coalesce(F.col("text"), F.concat(ask, more, F.lit("\n"), reply), F.array_join(F.transform(said, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n"))


def archive_members(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """(archive, member, content) of zip and tar archives (plain, gz, bz2, xz); whole members as text."""

    def run(batches):
        for b in batches:
            rows = []
            for name, data in zip(b["path"], b["content"]):
                if zipfile.is_zipfile(io.BytesIO(data)):
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        rows += [(name, m, z.read(m).decode("utf-8-sig", "replace")) for m in z.namelist() if m.endswith(suffix) and not m.endswith("/")]
                else:
                    with tarfile.open(fileobj=io.BytesIO(data)) as t:
                        rows += [(name, m.name, t.extractfile(m).read().decode("utf-8-sig", "replace")) for m in t.getmembers() if m.isfile() and m.name.endswith(suffix)]
            yield pd.DataFrame(rows, columns=["archive", "member", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, member string, content string")


SQUAD = "data array<struct<title string, paragraphs array<struct<context string, qas array<struct<id string, question string, answers array<struct<text string, answer_start int>>>>>>>>"


def squad(docs: DataFrame, json_col: str) -> DataFrame:
    """(id, title, context, question, answer): questions of nested reading sets whose answer stands in the context."""
    own = docs.select(F.explode(F.from_json(json_col, SQUAD)["data"]).alias("d")).select("d.title", F.explode("d.paragraphs").alias("p")).select("title", "p.context", F.explode("p.qas").alias("q"))
    answer = F.try_element_at(F.col("q.answers"), F.lit(1))["text"]
    return own.select("q.id", "title", "context", "q.question", answer.alias("answer")).filter(F.contains("context", F.col("answer")) & (F.col("answer") != ""))


def parity_dialogue(turns: Column) -> Column:
    """Messages of a bare list of turns: user and assistant by turns."""
    return F.transform(turns, lambda t, i: F.struct(F.when(i % 2 == 0, "user").otherwise("assistant").alias("role"), t.alias("content")))


def newest_edit(edits: Column, original: Column) -> Column:
    """The last edit that isn't empty, else the original."""
    return F.coalesce(F.try_element_at(F.filter(edits, lambda x: x != ""), F.lit(-1)), original)


def best_path(tree_json: pd.Series) -> pd.Series:
    """Of nested reply trees the path of best replies: lowest rank, most reviews, then id; roles take turns."""
    out = []
    for raw in tree_json:
        node = json.loads(raw) if raw else {}
        path, role = [], "prompter"
        while node and node.get("role") == role and not node.get("deleted"):
            path.append({"role": "user" if role == "prompter" else "assistant", "content": node.get("text") or ""})
            role = "assistant" if role == "prompter" else "prompter"
            nxt = [r for r in node.get("replies") or [] if r.get("role") == role and not r.get("deleted")]
            node = max(nxt, key=lambda r: (r.get("rank") == 0, r.get("review_count") or 0, not r.get("synthetic"), str(r.get("message_id")))) if nxt else None
        if path and path[-1]["role"] != "assistant":
            path.pop()
        out.append(path if len(path) >= 2 else [])
    return pd.Series(out)


def reply_paths(docs: DataFrame, json_col: str) -> DataFrame:
    """The rows with ``messages``, the best path of each reply tree; empty where none leads to an answer."""
    return docs.withColumn("messages", F.pandas_udf(best_path, MESSAGES)(json_col))
