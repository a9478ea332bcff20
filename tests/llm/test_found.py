import json
import random

import pytest
from pyspark.sql import functions as F

from loomery.llm import catalog, copies, cutoff, defects, fmindex, overlap, pieces, prose, reading
from loomery.llm.fmindex import Index, symbols

import numpy as np


def got(df):
    return sorted(tuple(r) for r in df.collect())


# --- cutoffs -------------------------------------------------------------------------------------


def test_cutoffs_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", " A", "b", None, ""]), rng.choice([None, float("nan"), -1.0, 0.5, 1.25, 2.0, 2.0, 3.5])) for _ in range(400)]
    targets = [("A ", 30), ("b", 100), ("c", 10), ("b", 5)]
    df = spark.createDataFrame(rows, "source string, score double").withColumn("n", F.lit(1)).withColumn("part", F.lit(2))
    out = {r.source: (r.cutoff, r.kept_rows) for r in cutoff.keep_cutoffs(df, spark.createDataFrame(targets, "source string, keep_percent int"), partitions=5).collect()}
    for s, p in (("a", 30), ("b", 100)):
        own = sorted((x for k, x in rows if k and k.strip().lower() == s and x is not None and x == x), reverse=True)
        want = next(c for c in sorted(set(own), reverse=True) if 100 * sum(x >= c for x in own) >= p * len(own))
        assert out[s] == (want, sum(x >= want for x in own))
    assert set(out) == {"a", "b"}
    assert cutoff.keep_cutoffs(df.limit(0), spark.createDataFrame(targets, "source string, keep_percent int")).count() == 0


# --- pieces --------------------------------------------------------------------------------------


def test_pieces_hold_the_whole_text(spark):
    text = "第一句话说完了。第二句话，有逗号，也说完了！" * 12 + "长" * 90 + "。End of it. And more words here"
    data = [("d1", "k", text, "2025-01-01"), ("d1", "k", text, "2025-01-02"), ("d2", "k", "短。", None), ("d3", "k", None, None), ("d4", "other", text, None), ("d5", "k", "😀字" * 40, None)]
    docs = spark.createDataFrame(data, "document_id string, category string, source string, added_at string").withColumn("max_chars", F.lit(3)).withColumn("pieces", F.lit("x"))
    lim = spark.createDataFrame([("k", 60, 10), ("bad", 0, 5)], "category string, max_chars int, overlap_chars int")
    out = {r.document_id: r for r in pieces.split_oversized(docs, lim).collect()}
    assert set(out) == {"d1", "d5"}
    for d, t in (("d1", text), ("d5", "😀字" * 40)):
        ps, at = out[d].pieces, 0
        for i, p in enumerate(ps):
            assert len(p.piece) <= 60 and p.at == at + 1
            back = min(10, at) if i else 0
            assert p.piece == t[at - back : at + p.own]
            at += p.own
        assert at == len(t)
    assert all(not all(p.natural for p in out[d].pieces) for d in out)
    assert all(p.natural for p in out["d1"].pieces[:4])


def pieces_of(spark, text, full, overlap):
    docs = spark.createDataFrame([("d", "k", text, "2025")], "document_id string, category string, source string, added_at string")
    return pieces.split_oversized(docs, spark.createDataFrame([("k", full, overlap)], "category string, max_chars int, overlap_chars int")).first().pieces


def test_a_sentence_that_fits_stays_whole(spark):
    one, two = "甲" * 90 + "。", "乙" * 90 + "。"
    got = pieces_of(spark, one + two, 100, 20)
    assert [(p.at, p.own, p.natural, p.piece) for p in got] == [(1, 91, True, one), (92, 91, True, "甲" * 8 + "。" + two)]
    full = pieces_of(spark, "字" * 100 + "。" + "尾" * 30, 100, 20)
    assert [(p.own, p.natural) for p in full] == [(100, True), (31, True)]


def test_forced_only_in_long_stretches(spark):
    import re as regex

    rng = random.Random(12)
    for _ in range(25):
        text = "".join(rng.choice(["字" * rng.randint(1, 28), "。", "，", " ", "”", "。”）", ".", "\n", "b" * rng.randint(1, 24)]) for _ in range(40))
        full, overlap = rng.randint(12, 26), rng.randint(0, 15)
        if len(text) <= full:
            continue
        overlap = min(overlap, full - 1)
        got = pieces_of(spark, text, full, overlap)
        assert "".join(p.piece[len(p.piece) - p.own :] for p in got) == text and all(len(p.piece) <= full for p in got)
        assert any(not p.natural for p in got) == any(len(x) > full for x in regex.split(pieces.BOUNDARY, text))


# --- copies --------------------------------------------------------------------------------------


def test_copies_by_mode(spark):
    a, b = {"name": "河道 5", "place": "A-1", "sub": {"x": [1, 2]}}, {"PLACE": "a1", "sub": {"X": ["1", "2"]}, "name": "河道5"}
    rows = [
        (1, "你好，世界。", "s"), (2, "你 好\n世界", " S"), (3, json.dumps(a), "s"), (4, json.dumps(b, indent=2), "s"), (5, json.dumps({**a, "sub": {"x": [2, 1]}}), "s"),
        (6, "name：甲\nplace：乙", "s"), (7, "place: 乙 \nname: 甲", "s"), (8, "name：乙\nplace：甲", "s"), (9, "你好，世界。", "e"), (10, "你好，世界。", "e"), (11, "你好世界", "e"),
        (12, "你好", "n"), (13, "你好", "n"), (14, None, "s"), (15, None, "s"), (16, "。。", "s"), (17, "！", "s"), (18, "你好，世界。", None), (19, "名=甲；地=乙；数=1", "s"), (20, "数 = 1; 名 = 甲; 地 = 乙", "s"), (2, "你 好\n世界", " S"),
    ]
    df = spark.createDataFrame(rows, "record_id bigint, text string, source string").withColumn("_key", F.lit(1))
    pol = spark.createDataFrame([("s", "normalized"), ("e", "exact"), ("n", "none")], "source string, dedupe_mode string")
    groups, found = copies.collapse_copies(df, pol)
    assert got(found) == [(1, 2), (3, 4), (6, 7), (9, 10), (19, 20)]
    assert {tuple(r) for r in groups.collect()} == {(1, 2), (3, 2), (6, 2), (9, 2), (19, 2)}
    assert copies.collapse_copies(df.limit(0), pol)[1].count() == 0


def test_fields_behind_breaks_and_rules(spark):
    rows = [(1, "name：甲\nplace：乙", "s"), (2, "\n\nplace: 乙\nname: 甲", "s"), (3, "-----\nplace: 乙\nname: 甲", "s"), (4, " " * 50 + "place: 乙\nname: 甲", "s"), (5, "\u200b\n" + '{"place": "乙", "name": "甲"}', "s"), (6, "\n甲 乙", "s")]
    pol = spark.createDataFrame([("s", "normalized")], "source string, dedupe_mode string")
    assert got(copies.collapse_copies(spark.createDataFrame(rows, "record_id bigint, text string, source string"), pol)[1]) == [(1, 2), (1, 3), (1, 4), (1, 5)]


def test_arrays_at_the_top_and_long_names(spark, monkeypatch):
    long = "the name of a field that goes on for much longer than most names do"
    rows = [
        (1, '[{"a":1,"b":2}]', "s"), (2, '[{"b":2,"a":1}]', "s"), (3, '[{"b":1,"a":2}]', "s"), (4, "[1, 2]", "s"), (5, "1 2", "s"), (6, "[2, 1]", "s"),
        (7, f"{long}: x1\nkind: y1", "s"), (8, f"kind: y1\n{long.upper()} = x1", "s"), (9, '[[{"x": [1, {"p": 1, "q": 2}]}]]', "s"), (10, '[[{"X": ["1", {"q": 2, "p": 1}]}]]', "s"), (11, "[注] {见下}", "s"),
    ]
    df = spark.createDataFrame(rows, "record_id bigint, text string, source string")
    pol = spark.createDataFrame([("s", "normalized")], "source string, dedupe_mode string")
    want = [(1, 2), (4, 5), (7, 8), (9, 10)]
    assert got(copies.collapse_copies(df, pol)[1]) == want
    monkeypatch.setattr(copies, "MOST_BITS", 2)  # more digests than bits: no map
    assert got(copies.collapse_copies(df, pol)[1]) == want


def test_prose_with_colons_is_no_record():
    assert copies.parse("甲：今天天气很好。我们去公园。\n乙：好的。") is None and copies.parse("{broken") is None
    assert copies.parse("a：1\na：2") is None


# --- overlaps ------------------------------------------------------------------------------------


def test_suffixes_stand_in_order():
    rng = random.Random(8)
    for text in (b"", b"\0", b"a" * 300, bytes(rng.choice(b"ab\0") for _ in range(500)), (b"abcabcab\0" * 40)):
        assert fmindex.suffix_order(np.frombuffer(text, np.uint8)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_spans_are_maximal_and_merged():
    a, b = (np.array([ord(c) for c in x], np.uint32) for x in ("abcdefghXijklmn", "abcdefghijklmnop"))
    assert overlap.matched_spans(a, b, [0, -1], 3) == (2, 14) and overlap.matched_spans(a, b, [5], 3) == (0, 0)


def test_index_counts_like_a_scan():
    rng = random.Random(5)
    fields = ["".join(rng.choice("甲乙丙丁ab") for _ in range(rng.randint(0, 60))) for _ in range(40)]
    text, starts = [], []
    for f in fields:
        starts.append(len(text))
        text += [*symbols(np.array([ord(c) for c in f], np.uint32)).tolist(), fmindex.CLOSE]
    ix = Index.unpack(Index.build(np.array(text, np.uint8), np.array(starts)).pack())
    for _ in range(200):
        p = "".join(rng.choice("甲乙丙丁ab") for _ in range(rng.randint(1, 14)))
        s = symbols(np.array([ord(c) for c in p], np.uint32))
        lo, hi = ix.search(s, np.array([0]), np.array([len(s)]))
        want = sorted((i, k) for i, f in enumerate(fields) for k in range(len(f)) if f.startswith(p, k))
        places = ix.locate(np.arange(lo[0], hi[0]))
        own = ix.field(places)
        assert sorted(zip(own.tolist(), (places - ix.starts[own]).tolist())) == want


def brute(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def test_distance():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert overlap.distance(a, b) == brute(a, b)


def test_overlaps_against_brute_force(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("天地人和山水风云日月") for _ in range(n))

    def edit(t, k):
        for _ in range(k):
            i = rng.randrange(len(t))
            t = rng.choice([t[:i] + "x" + t[i:], t[:i] + t[i + 1 :], t[:i] + "y" + t[i + 1 :]])
        return t

    rows, base = [], [(word(60), word(40)) for _ in range(12)]
    for i in range(160):
        s, t = rng.choice(base)
        rows.append((i, rng.choice(["train", " Train", "test", "validation "]), edit(s, rng.randint(0, 8)), edit(t, rng.randint(0, 6))))
    rows += [(200, "train", None, "a"), (201, "test", "  ", "a"), (202, "train", "同", "略"), (203, "test", "同。", "【略】"), (204, "other", *base[0]), (205, None, *base[0])]
    df = spark.createDataFrame(rows, "pair_id bigint, split string, source string, target string").withColumn("key", F.lit(1))
    n = lambda t: "".join(c for c in t.lower() if c.isalnum())
    near = lambda a, b: brute(a, b) <= max(len(a), len(b)) // 10
    own = [(i, (k or "").strip().lower(), n(s), n(t)) for i, k, s, t in rows if s and t and s.strip() and t.strip()]
    want = sorted((min(a[0], b[0]), max(a[0], b[0])) for a in own for b in own if a[1] == "train" and b[1] in ("test", "validation") and near(a[2], b[2]) and near(a[3], b[3]))
    assert len(want) > 50 and got(overlap.overlap_pairs(df)) == want
    assert overlap.overlap_pairs(df.limit(0)).count() == 0


def test_pairs_of_symbols_alone(spark):
    rows = [(1, "train", "……", "？！"), (2, "validation", "。", "——"), (3, "train", "a", "！"), (4, "test", "A。", "？"), (5, "test", "b", "？"), (6, "train", "甲乙丙丁", "。")]
    df = spark.createDataFrame([(*r, "o") for r in rows], "pair_id bigint, split string, source string, target string, origin string")
    assert got(overlap.overlap_pairs(df)) == [(1, 2), (3, 4)]
    assert got(overlap.overlap_pairs(df.filter("pair_id < 3"))) == [(1, 2)]
    assert got(overlap.overlap_report(df)) == [("test", "o", 2, 1), ("validation", "o", 1, 1)]


def test_many_shards_give_the_same(spark, sf, monkeypatch):
    df = spark.read.parquet(f"{sf}/pair_records.parquet")
    one = got(overlap.overlap_pairs(df))
    monkeypatch.setattr(overlap, "LEAST_SYMBOLS", 500)
    monkeypatch.setattr(overlap, "MOST_SYMBOLS", 2000)
    monkeypatch.setattr(overlap, "TASK_SYMBOLS", 5000)
    monkeypatch.setattr(overlap, "SEARCH_ROWS", 7)
    assert got(overlap.overlap_pairs(df)) == one and one


# --- defects -------------------------------------------------------------------------------------


@pytest.mark.parametrize("target, want", [(None, True), ("", True), (" \n", True), ("N/A", True), ("（略）", True), ("<|im_end|>", True), ("……", True), ("暂无变化", False), ("3", False)])
def test_empty(target, want):
    assert defects.is_empty(target) == want


S = "由于客流持续增加的缘故，编号Za-847的终端目前暂时无法正常完成对桥梁支座的识别操作。"


@pytest.mark.parametrize("target, want", [
    ("抱歉，我无法改写这段内容。", True), ("I'm sorry, but I can't help with that.", True), ("很抱歉，出于谨慎考虑，我不能处理这类文本，请换一段文字再试。", True), ("對不起，我沒有辦法回答這個問題。", True),
    ("客服回复读者：“抱歉，我无法办理这项业务。”因此读者离开了。", False), ("Za-847终端暂时无法识别桥梁支座。", False),
])
def test_refusal(target, want):
    assert defects.is_refusal(S, target) == want


LONG = "I'm sorry, but I can't help with rewriting the passage that you have sent to me today. I would suggest that you look for another tool which is made for this kind of work, or that you ask a colleague who knows the subject well. If you like, please share another passage with me, and I will gladly have a look at it and tell you whether it is something that I am able to work on for you."


@pytest.mark.parametrize("source, target, want", [
    (S, LONG, True), (None, LONG, True), (S, "谢谢您的来信，我仔细读过了这一段文字。" * 18 + "很抱歉，我无法改写这段内容。", True),
    (S * 8, "抱歉，我无法改写这段内容：" + S * 8, True), (S, "终端识别不了支座，工人们今天去现场检查线路，下午再试一次。" * 12, False),
    ("他说很抱歉，我无法改写这段内容，然后就走了。" + S, "大家在会上谈了很久，谁也没有想出办法来。" * 30 + "最后他说，很抱歉，我无法改写这段内容，于是走了。", False),
])
def test_long_refusals(source, target, want):
    assert len(defects.plain(target)) > 260 and defects.is_refusal(source, target) == want


def test_copies_and_languages():
    assert defects.is_copied(S, "改写：" + S.replace("，", " ")) and defects.is_copied(S, S * 2) and defects.is_copied(S, S.replace("桥", "乔"))
    assert not defects.is_copied(S, "Za-847终端暂时无法识别桥梁支座。") and not defects.is_copied(S, S[:30])
    assert defects.is_other_language(S, "The terminal cannot recognise the bridge because of visitors.")
    assert defects.is_other_language(S, "図書館は秋までに計画を見直すことを決めました。") and not defects.is_other_language(S, "因客流持續增加，Za-847終端暫時無法識別 CoreDNS gRPC Webhook。")
    assert not defects.is_other_language(S, "工作人员在门口的牌子上写了一行字“出口はこちら”，并且请大家注意。")
    assert defects.is_other_language("The library will close the hall in May.", "La bibliothèque a décidé de fermer la salle avant mai.")


def test_closed_ends():
    assert defects.closed("客服说：“抱歉。”（详见附件）") and defects.closed("好了。（见附件））") and defects.closed("Done. [1]") and not defects.closed("他说（见附件）") and not defects.closed("还没……")


def test_flags(spark, sf):
    pairs = spark.read.parquet(f"{sf}/pair_records.parquet")
    extra = spark.createDataFrame([(-1, None, "好的。"), (-2, "原文。", None), (-3, None, None)], "pair_id bigint, source string, target string")
    dec = spark.createDataFrame([(1, -1, True, "2025-01-02"), (2, -1, False, "2025-01-01"), (3, -2, True, None), (4, -9, True, None)], "decision_id bigint, pair_id bigint, truncated boolean, decided_at string")
    out = {r.pair_id: r.defect for r in defects.flag_pairs(pairs.select("pair_id", "source", "target").unionByName(extra), dec).collect()}
    assert out[-1] == "truncated" and out[-2] == "empty" and out[-3] == "empty" and -9 not in out
    assert defects.flag_pairs(pairs.limit(0), dec).count() == 0


# --- prose ---------------------------------------------------------------------------------------


def test_kinds(spark, sf):
    rec = [
        (1, "今天的天气很好，我们在公园里看到了很多人。大家都很高兴，因为春天来了。", "a"), (2, "1. 毛巾\n2. 水杯\n3. 雨衣\n4. 电池\n5. 粉笔", "a"), (3, "名称\t数量\t地点\n毛巾\t12\t青山\n水杯\t7\t河西\n雨衣\t9\t河东", "a"),
        (4, "哈" * 120, "a"), (5, None, "a"), (6, " \n\t", "a"), (7, "今天的天气很好，我们在公园里看到了很多人。".encode().decode("latin-1"), None), (8, '{"name": "x", "place": "y", "code": "Ka-1"}', "zz"), (9, "The dog ran to the shop, and it was happy. Where is the book? It is in the house.", "a"),
    ]
    df = spark.createDataFrame(rec, "record_id bigint, text string, source string").withColumn("x", F.lit(0)).withColumn("kind", F.lit(0))
    sf = "/root/testdata/sf0.01"
    own = spark.read.parquet(f"{sf}/text_records.parquet").select((F.col("record_id") + 1000).alias("record_id"), "text", "source", F.lit(0).alias("x"), F.lit(0).alias("kind"))
    words, pol = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("common_words", "cleaning_policies"))
    out = {r.record_id: r for r in prose.classify_texts(df.unionByName(own), words, pol).filter("record_id < 1000").collect()}
    assert {k: r.kind for k, r in out.items()} == {1: "prose", 2: "list", 3: "table", 4: "junk", 7: "junk", 8: "table", 9: "prose"}
    assert out[1].line_end_share == 1 and out[1].han_share > 0.8 and out[8].within_policy is None
    assert prose.classify_texts(df.limit(0), words, pol).count() == 0


# --- reading -------------------------------------------------------------------------------------


def test_levels(spark, sf):
    easy, mid, hard = "小猫很高兴。", "据气象台公布，今年降雨量同比增长两成。", "凡因合同所生之争议，应依侵权责任之法理予以认定。"
    docs = [(i, t * 6, None) for i, t in enumerate([easy, mid, hard] * 30)] + [(500, None, None), (501, "123 ！", None), (502, "", None), (503, easy * 2 + hard * 9, None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, grade int")
    lab = spark.createDataFrame([(i, i % 3 + 1, "r", "2025") for i in range(60)] + [(0, 3, "r", "2024"), (1, None, "q", "2025"), (2, 3, "r", "2025"), (900, 1, "r", "2025")], "doc_id bigint, grade int, rater string, rated_at string")
    out = {r.doc_id: r.grade for r in reading.reading_levels(df, lab).collect()}
    assert {out[i] == i % 3 + 1 for i in range(90)} == {True} and out[503] == 3 and not {500, 501, 502} & set(out)
    assert reading.reading_levels(df.limit(0), lab).count() == 0
    assert set(r.grade for r in reading.reading_levels(df, lab.limit(0)).collect()) == {2}


def test_letters_of_any_script_count():
    w = np.zeros(reading.DIMS + reading.SYNTAX)
    texts = ["ＡＢＣ　ｄｅｆ", "ㄅㄆㄇ", "ꀀꀁ", "豈更", "12！"]
    assert set(reading.sentence_scores(w, texts)[0].tolist()) == {0, 1, 2, 3}
    assert reading.sentence_scores(w, ["字"])[0].tolist() == [0] and reading.sentence_scores(w, [""])[0].tolist() == []


def test_isotonic():
    step, value = reading.isotonic(np.array([3.0, 1.0, 2.0, 4.0]), np.array([2.0, 1.0, 3.0, 5.0]), np.ones(4))
    assert step.tolist() == [1, 2, 4] and value.tolist() == [1, 2.5, 5]


def test_holdout_agrees_with_raters(spark):
    d = "/root/testdata/sf0.01"
    docs, lab = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/reading_labels.parquet")
    grades = reading.label_grades(lab)
    fit = lab.join(grades.filter("doc_id % 2 = 0").select("doc_id"), "doc_id", "left_semi")
    held = grades.filter("doc_id % 2 = 1").join(reading.reading_levels(docs, fit).select("doc_id", F.col("grade").alias("level")), "doc_id")
    n = held.agg(F.avg((F.abs(F.col("grade") - F.col("level")) <= 0.5).cast("double"))).first()[0]
    assert n > 0.9


def test_catalog_names():
    assert {f"p{i}_found" for i in (1, 2, 3, 4, 5, 6, 9)} | {"p7_ids", "p8_packed"} <= set(catalog.queries())
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
