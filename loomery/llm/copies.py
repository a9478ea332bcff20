"""Problem 5: records equal but for formatting, collapsed with their number of copies."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import plain_key

#: Rows of one digest are spread over so many tasks before they meet.
SALTS = 64
#: Bits of the map that says which digests may occur twice, for each digest that does, and in all: the map then has
#: at most 2 ** 22 words of 16 bytes. With more digests than bits it would let all forms through and is left out.
BITS_EACH, MOST_BITS = 16, 1 << 28
_NAMED = re.compile(r"\s*([^：:=;；{}\"。！？!?]+?)\s*[：:=]\s*(.+?)\s*\Z", re.S)
_OTHER = re.compile(r"[\W_]+")


def leaf(value: str) -> str:
    """A leaf in its plain form: letters and digits only, lower case."""
    return _OTHER.sub("", "".join(c for c in value if unicodedata.category(c)[0] not in "CM").lower())


def parse(text: str):
    """The nested record a text holds: pairs for named fields, lists for arrays; None for running text."""
    body = "".join(c for c in text if unicodedata.category(c) != "Cf").strip()
    if body[:1] == "{" or body[:1] == "[" and "{" in body:
        try:
            node = json.loads(body, object_pairs_hook=lambda pairs: ("object", pairs), parse_int=str, parse_float=str, parse_constant=str, strict=False)
            if _has_object(node):  # an array of values alone has its order and compares as running text
                return node
        except (ValueError, RecursionError):
            pass
    for parts in (re.split(r"[\r\n  \x85]+", body), re.split(r"[;；\r\n]+", body)):
        found = [_NAMED.match(p) for p in parts if leaf(p)]
        if len(found) >= 2 and all(found):
            pairs = [(m[1], m[2]) for m in found]
            if len({leaf(k) for k, _ in pairs} - {""}) == len(pairs) and not any(re.search(r"[。！？!?]\S", v) for _, v in pairs):
                return ("object", pairs)
    return None


def _has_object(node) -> bool:
    return isinstance(node, tuple) or isinstance(node, list) and any(map(_has_object, node))


def merkle(node) -> tuple[bytes, str]:
    """Digest and canonical form of a nested record, from the leaves up; children of an object have no order."""
    if isinstance(node, tuple):
        kids = sorted((hashlib.md5(leaf(k).encode()).digest() + d, leaf(k) + "=" + c) for k, (d, c) in ((k, merkle(v)) for k, v in node[1]))
        return hashlib.md5(b"O" + b"".join(d for d, _ in kids)).digest(), "{" + ",".join(c for _, c in kids) + "}"
    if isinstance(node, list):
        kids = [merkle(v) for v in node]
        return hashlib.md5(b"A" + b"".join(d for d, _ in kids)).digest(), "[" + ",".join(c for _, c in kids) + "]"
    plain = leaf(str(node))
    return hashlib.md5(b"L" + plain.encode()).digest(), plain


@F.pandas_udf(T.StructType().add("digest", T.BinaryType()).add("form", T.StringType()))
def _fields(texts: pd.Series) -> pd.DataFrame:
    out = []
    for t in texts:
        node = parse(t) if t else None
        try:
            out.append(merkle(node) if node is not None else (None, None))
        except RecursionError:
            out.append((None, None))
    return pd.DataFrame(out, columns=["digest", "form"])


def _forms(records: DataFrame, policies: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, key, form, salt) of every record that counts."""
    modes = policies.select(plain_key("source").alias("_source"), plain_key("dedupe_mode").alias("_mode")).filter("_mode in ('normalized', 'exact')")
    modes = modes.groupBy("_source").agg(F.max("_mode").alias("_mode"))
    rows = records.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), plain_key(source_col).alias("_source"))
    rows = rows.filter("_text is not null and _source is not null").join(modes, "_source")
    # an object has a brace, and two named fields have two marks between names and values: no other text is parsed
    maybe = (F.col("_mode") == "normalized") & F.regexp_like("_text", F.lit(r"\{|[：:=][^：:=]*[：:=]"))
    rows = rows.withColumn("_f", _fields(F.when(maybe, F.col("_text"))))
    plain = F.lower(F.regexp_replace("_text", r"[^\p{L}\p{N}]+", ""))
    form: Column = F.when(F.col("_mode") == "exact", F.col("_text")).otherwise(F.coalesce("_f.form", plain))
    counts = F.regexp_like("_text", F.lit(r"[\p{L}\p{N}]"))
    rows = rows.filter(counts).withColumn("_form", form)
    digest = F.unhex(F.md5(F.concat_ws("\0", "_source", F.coalesce(F.hex("_f.digest"), F.md5("_form")))))
    return rows.select("_id", digest.alias("_key"), "_form", F.pmod(F.xxhash64("_id", "_form"), F.lit(SALTS)).cast("int").alias("_salt"))


def collapse_copies(
    records: DataFrame, policies: DataFrame, id_col: str = "record_id", text_col: str = "text", source_col: str = "source"
) -> tuple[DataFrame, DataFrame]:
    """The groups and their members: (first id, copies) and (first id, id) of each copy but the first.

    Records of one source count as copies by the source's dedupe_mode: ``normalized`` compares letters and
    digits in lower case, and named fields (JSON objects, name and value one after the other) in any order;
    ``exact`` compares texts as stored; under ``none``, another or no mode nothing is a copy. Null texts,
    texts without a letter or digit and records without a source are in no group. An id that occurs twice
    is one record. Copies of one text stay apart in SALTS tasks until counts and smallest ids are known.

    Records are hashed from the leaves up, children of unordered nodes sorted by digest, and grouped by the
    root digest; then each member's whole canonical form is compared with its group's first. Members that
    differ although their digests are equal form groups by their canonical forms.
    """
    forms = materialize(_forms(records, policies, id_col, text_col, source_col), "forms")
    # pre-aggregated digests, then one row for each digest held by more than one record
    part = forms.groupBy("_key", "_salt").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    many = materialize(part.groupBy("_key").agg(F.sum("_n").alias("_n"), F.min("_first").alias("_first")).filter("_n > 1"), "digests")
    spread = part.select("_key", "_salt").join(many.select("_key", "_first"), "_key")
    maybe, n = forms, many.count()
    if n <= MOST_BITS:
        # a map sized by the digests keeps most forms that have no copy out of the shuffle; what it lets through is joined exactly
        bits = min(MOST_BITS, max(1 << 16, 1 << (BITS_EACH * n).bit_length()))
        place = F.pmod(F.xxhash64("_key"), F.lit(bits))
        word, bit = F.shiftright(place, 6).alias("_word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(_key), {bits}) & 63 as int))")
        words = many.groupBy(word).agg(F.bit_or(bit).alias("_bits"))
        maybe = forms.withColumn("_word", F.shiftright(place, 6)).join(F.broadcast(words), "_word").filter(F.col("_bits").bitwiseAND(bit) != 0).drop("_word", "_bits")
    members = maybe.join(spread, ["_key", "_salt"])
    # the first member's form goes to all tasks that hold members
    first = members.filter("_id = _first").groupBy("_key").agg(F.min("_form").alias("_of_first"))
    checked = members.join(spread.select("_key", "_salt").join(first, "_key"), ["_key", "_salt"])
    same = F.col("_form") == F.col("_of_first")
    copies = checked.filter(same & (F.col("_id") != F.col("_first"))).select(F.col("_first").alias(f"first_{id_col}"), F.col("_id").alias(id_col)).distinct()
    odd = checked.filter(~same).select("_key", "_form", "_id").distinct()
    odd_first = odd.groupBy("_key", "_form").agg(F.min("_id").alias("_first"))
    rest = odd.join(odd_first, ["_key", "_form"]).filter("_id <> _first").select(F.col("_first").alias(f"first_{id_col}"), F.col("_id").alias(id_col))
    copies = copies.unionByName(rest)
    groups = copies.groupBy(f"first_{id_col}").agg((F.count("*") + 1).alias("copies"))
    return groups, copies
