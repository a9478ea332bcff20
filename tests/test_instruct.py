import json

import pytest
from pyspark.sql import functions as F

from loomery.functions import choices, forms
from loomery.functions import text as tx
from loomery.operators import metrics, ranking, tokens, validation
from loomery.session import release, scratch, shared_dir
from loomery.sources import cache, sets

MS = "array<struct<role string, content string>>"


def reasons(spark, conversations, source="other", category="x", **more):
    rows = [([(r, c) for r, c in ms], len("".join(c for _, c in ms)), 5) for ms in conversations]
    df = spark.createDataFrame(rows, f"m {MS}, t int, a int")
    return [r[0] for r in df.select(validation.filter_reason(F.col("m"), F.lit(source), F.lit(category), F.col("t"), F.col("a"), **more)).collect()]


def test_filter_reasons(spark):
    talk = lambda q, a: [("user", q), ("assistant", a)]
    long = "这是一个足够长的问题吗"
    got = reasons(spark, [
        talk(long, "是的，已经足够长了。"), [("user", long)], [("user", long), ("user", long)], [("assistant", long), ("user", long), ("assistant", long)], [("user", long), ("assistant", long), ("assistant", long)], talk("短", "短"), talk(long, "字" * 12_001),
        talk(long, "<think>嗯</think>好的好的"), talk(long, "<|im_start|>好的"), talk(long, "well well well well then"), talk(long, "坏字�坏字坏字"), talk(long, "响铃\x07响铃响铃"), talk(long, "作为一个人工智能，我会的。"), talk(long, "字" * 3000),
    ])
    assert got == [
        None, "too_few_messages", "does_not_end_assistant", "does_not_start_user", "roles_not_alternating", "too_short", "single_message_too_long", "visible_think_tags", "foreign_chat_marker", "repeated_latin_noise", "replacement_character", "control_character", "assistant_model_identity", "over_max_tokens",
    ]
    strict = reasons(spark, [talk("你好\n助手：我在这里等你", "好的好的好的"), talk(long, "Привет, 你好你好"), talk(long, "好，goal！好的好的"), talk(long, "字段 parentId 不对不对")], "smoltalk_chinese", "everyday")
    assert strict == ["embedded_assistant_text", "unexpected_script_mixing", "everyday_goal_leak", "smoltalk_template_artifact"]
    assert reasons(spark, [talk(long, "作为一个人工智能，我会的。")], "synthetic_identity_verified") == [None] and reasons(spark, [talk(long, "好好好好好好")], least_tokens=6) == ["assistant_too_short"]


@pytest.mark.parametrize("source, target, want", [
    ("有3个，可能是A。", "有4个，可能是A。", "numbers_changed"), ("用GPU算的", "用gpu算的", "latin_terms_changed"), ("他读《书》了", "他读《诗》了", "protected_text_changed"), ("他可能来了", "他来了", "scope_terms_changed"), ("他来了", "他来了。", "only_marks_changed"),
    ("一二三四五六七八九十一二三四五六七八九十", "一二三", "numbers_changed"), ("天" * 30, "天" * 20, "too_much_removed"), ("天" * 10, "天" * 20, "too_long"), ("天地", "天地", None), (None, "x", None),
])
def test_target_issue(spark, source, target, want):
    if want == "numbers_changed" and "3" not in source:
        want = "too_much_removed"
    assert spark.createDataFrame([(source, target)], "s string, t string").select(validation.target_issue(F.col("s"), F.col("t"))).first()[0] == want


def test_outputs_reviews_and_reverts(spark):
    i = spark.createDataFrame([(1, "a", "有3个"), (2, "b", "天"), (3, "c", "地"), (4, "d", "人")], "place int, key string, source string")
    o = spark.createDataFrame([(1, "a", "simplified", "有4个"), (2, "x", "keep", "天天"), (3, "c", "maybe", " "), (5, "e", "keep", "x")], "place int, key string, decision string, target string")
    assert {tuple(r) for r in validation.output_issues(i, o).collect()} == {("a", "number_mismatch"), ("b", "key_or_order_mismatch"), ("b", "keep_changed_text"), ("c", "invalid_decision"), ("c", "empty_target"), ("d", "missing_output"), ("e", "extra_output")}
    r = spark.createDataFrame([("a", "revert", "有3个"), ("x", "revise", "天")], "key string, decision string, target string")
    out = {x.key: (x.decision, x.target, x.reviewed) for x in validation.apply_reviews(o, r).collect()}
    assert out["a"] == ("keep", "有3个", True) and out["x"] == ("simplified", "天", True) and out["c"][2] is False
    with pytest.raises(KeyError):
        validation.apply_reviews(o, r.withColumn("key", F.lit("zz")))
    back = validation.surface_reverts(spark.createDataFrame([("ＡＢ，c", "ab c", "simplified"), ("ab", "abc", "simplified"), (None, "x", "keep")], "source string, target string, decision string")).collect()
    assert [(x.reverted, x.decision) for x in back] == [(True, "keep"), (False, "simplified"), (False, "keep")]


def test_probes_and_unions(spark):
    df = spark.createDataFrame([(' {"a": 1} ',), ("[1]",), ("{a",), ("苹果，梨、桃",), (None,)], "t string")
    assert [tuple(r) for r in df.select(validation.is_json_object(F.col("t")), validation.three_items(F.col("t"))).collect()] == [(True, False), (False, False), (False, False), (False, True), (False, False)]
    f = lambda *xs: spark.createDataFrame([(x,) for x in xs], "file string")
    assert {tuple(r) for r in validation.union_state(f("a", "b"), f("b", "c"), f("a", "b", "d")).collect()} == {("b", "in_both"), ("c", "missing_in_full"), ("d", "only_in_full")}
    assert validation.union_state(f("a"), f("b"), f("a", "b")).count() == 0
    assert tuple(validation.bundle_report(df.limit(0), "t", 3).first())[:5] == (0, 0, 0, 0, 0)


def test_approved_replies(spark):
    m = "role string, lang string, deleted boolean, review_result boolean, text string, rank int, review_count int, labels map<string, struct<value double, count int>>"
    row = lambda **k: tuple({"role": "assistant", "lang": "zh", "deleted": None, "review_result": None, "text": "好", "rank": 0, "review_count": 2, "labels": None, **k}.values())
    rows = [row(), row(review_count=1), row(rank=1), row(labels={"spam": (0.2, 1)}), row(labels={"quality": (0.4, 2)}), row(labels={"quality": (0.4, 1), "spam": (0.2, 0)}), row(deleted=True), row(text=" "), row(lang=None)]
    df = spark.createDataFrame([(r,) for r in rows], f"m struct<{m}>")
    assert [r[0] for r in df.select(validation.reply_approved(F.col("m"), "assistant")).collect()] == [True, False, False, False, False, True, False, False, False]


def test_small_readers(spark):
    q = spark.createDataFrame([(1, "算", "3*4=<<3*4=12>>12\n<<1+1=2>>个\n#### 12", "train"), (2, "算", "x", "test")], "number int, question_zh string, answer_zh string, split string")
    assert [r.messages[1].content for r in sets.gsm8k(q).collect()] == ["3*4=3*4 = 12\n1+1 = 2个\n答案：12"]
    c = spark.createDataFrame([(1, "写", "参数 ['a b', 'c']", "[1, 2]", "py"), (2, "写", "x", "['x'", None)], "number int, instruction string, input string, output string, task_type string")
    assert [(r.messages[0].content, r.messages[1].content, r.category) for r in sets.leetcode(c).collect()] == [("写\n\n参数\na b\n\nc", "[1, 2]", "code_py"), ("写\n\nx", "['x'", "code_code")]
    good = json.dumps({"Q": "问", "A": "答"})
    r = spark.createDataFrame([("a", [f"```json\n{good}\n```", good, "broken"]), ("b", [good])], "source_id string, responses array<string>")
    assert [(x.source_id, len(x.messages)) for x in sets.correction_rounds(r).collect()] == [("a", 4)]
    t = spark.createDataFrame([("1", ["x"], [("user", "Use exactly 2 sentences."), ("assistant", "One. Two.")]), ("2", ["x"], [("user", "Tell me the latest."), ("assistant", "No.")]), ("3", [], [("user", "a"), ("assistant", "b")])], f"id string, constraints array<string>, messages {MS}")
    assert [x.source_id for x in sets.constrained(t).collect()] == ["1"]
    w = spark.createDataFrame([("x", "字" * 90 + "答案在这里", "问题是什么？", ["答案"]), ("y", "字" * 90 + "望采纳答案", "问题是什么？", ["答案"]), ("z", "答案", "问题是什么？", ["答案"])], "id string, context string, question string, answers array<string>")
    assert [x.source_id for x in sets.robust_reading(w).collect()] == ["x"] and sets.reading(w, "s").count() == 3
    d = spark.createDataFrame([(1, None, [("user", "a"), ("assistant", "b")]), (2, 9, [("user", "a")])], f"number int, idx int, messages {MS}")
    assert [(x.source, x.source_id) for x in sets.abilities(d, "code").collect()] == [("doit_code", "1")]
    f = spark.createDataFrame([("a", None, "问", "答"), ("b", [("human", "q"), ("gpt", "r")], None, None)], f"source_id string, messages {MS}, prompt string, response string")
    assert [[m.content for m in x.messages] for x in sets.flexible(f, "if").collect()] == [["问", "答"], ["q", "r"]]


def test_fields_files_and_logs(spark, tmp_path):
    df = spark.createDataFrame([([["a", None], ["b"]],), (None,)], "x array<array<string>>")
    assert [r[0] for r in df.select(sets.field_text(F.col("x"), "array<array<string>>")).collect()] == ["ab", ""]
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name in ("a.txt", "b.md", "deep/c.jsonl"):
        (tmp_path / "in" / name).write_text("step 1 loss 2.5\nother\nstep 2 loss 1.5\n")
    found = sets.find_files(spark, [str(tmp_path / "in"), str(tmp_path / "in" / "*.txt")])
    assert [f.rsplit("/", 1)[1] for f in found] == ["a.txt", "c.jsonl"]
    with pytest.raises(FileNotFoundError):
        sets.find_files(spark, [str(tmp_path / "none*")])
    got = sets.log_values(spark.read.text(found[0]), r"step (\d+) loss ([0-9.]+)", ["step", "loss"]).collect()
    assert [tuple(r) for r in got] == [(1, 1.0, 2.5), (3, 2.0, 1.5)]
    assert [r[0] for r in spark.createDataFrame([("Ａ，b +１ ",)], "t string").select(sets.folded_form("t")).collect()] == ["ab1"]


def test_choices_and_samples(spark):
    df = spark.createDataFrame([("甲_乙", "1", "2", "2", ["A", "B"], " B ", ["x", "y"])], "s string, a string, b string, k string, labels array<string>, key string, texts array<string>")
    g, q = df.select(choices.gap(F.col("s"), F.col("a"), F.col("b"), F.col("k")).alias("g"), choices.labelled(F.col("s"), F.col("texts"), F.col("labels"), F.col("key")).alias("q")).first()
    assert (g.context, g.options, g.answer_index) == ("甲", ["1乙", "2乙"], 1) and (q.options, q.answer_index) == ([" x", " y"], 1)
    with pytest.raises(Exception, match="no option"):
        df.select(choices.labelled(F.col("s"), F.col("texts"), F.col("labels"), F.lit("C"))).collect()
    assert df.select(choices.exam_zh(F.col("s"), F.col("texts"), F.lit("e"))).first()[0] is None and df.select(choices.exam_zh(F.col("s"), F.col("texts"), F.lit(" b"))).first()[0].answer_index == 1
    ranked = spark.range(10).select("id", F.col("id").alias("rank"))
    assert ranking.spread_blocks(ranked, "rank", 30, 4).count() == 10 and ranking.spread_blocks(ranked, "rank", 4, 2).count() == 4 and ranking.spread_blocks(ranked.limit(0), "rank", 4, 2).count() == 0
    assert sorted((r.pick, r.id) for r in ranking.rotating_pick(ranked, "rank", 12, 8).collect())[:3] == [(0, 8), (1, 9), (2, 0)] and ranking.rotating_pick(ranked.limit(0), "rank", 3, 0).count() == 0


def test_tables_can_be_released(spark):
    path = scratch(spark, "t")
    spark.range(3).write.parquet(path)
    assert path.startswith(shared_dir(spark)) and release(spark) >= 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_boundaries_and_windows(spark):
    assert tokens.boundary_settings({}) == {"policy": "strict", "document_attention": True, "ignore_cross_document_targets": True, "single_document_windows": False}
    assert tokens.boundary_settings({"document_attention": False, "ignore_cross_document_targets": False})["policy"] == "none"
    assert tokens.boundary_settings({"document_boundary_policy": "single_doc_windows"})["single_document_windows"] and tokens.boundary_settings({"document_boundary_policy": "strict_dense"})["policy"] == "strict"
    for bad in ({"document_boundary_policy": "x"}, {"document_boundary_policy": "none", "document_attention": True}):
        with pytest.raises(ValueError):
            tokens.boundary_settings(bad)
    df = spark.createDataFrame([([1, 2, 3, 4, 5, 6, 7],), ([1],), (None,)], "t array<int>")
    assert [r[0] for r in df.select(tokens.language_windows(F.col("t"), 3, 2)).collect()] == [[[1, 2, 3, 4], [3, 4, 5, 6], [5, 6, 7, 0]], [[1, 0, 0, 0]], None]
    starts = spark.createDataFrame([(0, 5), (5, 3), (8, 0), (8, 9)], "start bigint, n bigint")
    got = tokens.boundary_stats(starts, "start", "n", 4, 2).first()
    doc = [0] * 5 + [1] * 3 + [2] * 9
    windows = [doc[i : i + 4] for i in range(0, 14, 2)]
    assert (got.windows, got.targets, got.crossing_windows, got.crossing_targets) == (7, 21, sum(w[0] != w[3] for w in windows), sum(a != b for w in windows for a, b in zip(w, w[1:])))
    assert tuple(tokens.boundary_stats(starts.limit(0), "start", "n", 4, 2).first()) == (0, 0, 0, 0)


def test_paired_bootstrap(spark):
    df = spark.createDataFrame([(0.1 * (i % 5), 0.1 * (i % 5) + (0.05 if i % 4 else -0.02)) for i in range(400)] + [(None, 1.0)], "l double, r double")
    got = metrics.paired_bootstrap(df, "l", "r", 2000).first()
    assert got.cases == 400 and got.mean == pytest.approx(0.0325, abs=1e-4) and got.lower_95 < got.mean < got.upper_95 and got.win_rate == 0.75 and got.loss_rate == 0.25 and got.probability_better == 1
    assert metrics.paired_bootstrap(df.limit(0), "l", "r").count() == 0


def test_cache_and_stages(spark, tmp_path):
    docs = spark.createDataFrame([(i, [1, *range(4, 4 + i), 2]) for i in range(12)], "doc_id bigint, t array<int>")
    listed = cache.write_cache(docs, str(tmp_path / "c"), "doc_id", "t", 15, 60)
    back = cache.read_cache(spark, str(tmp_path / "c"))
    assert sorted((r.group, r.shard, r.documents, r.tokens) for r in listed.collect())[0] == (0, 0, 4, 14) and back.count() == 12
    assert cache.cache_errors(back, 30, 15).count() == 0
    assert {r.code for r in cache.cache_errors(back.withColumn("start", F.col("start") + 1), 10, 13).collect()} == {"id_out_of_range", "gap_or_overlap", "shard_too_large"}
    assert cache.cache_errors(back.withColumn("tokens", F.slice("tokens", 2, 100)), 30, 15).filter("code = 'not_framed'").count() == 12
    built = []
    make = lambda: built.append(1) or spark.range(3)
    runs = [cache.stage(spark, str(tmp_path), "s", k, make) for k in ({"a": 1, "b": 2}, {"b": 2, "a": 1}, {"a": 2, "b": 2})]
    assert [r[1] for r in runs] == [False, True, False] and len(built) == 2 and runs[1][0].count() == 3
    with pytest.raises(ValueError, match="b 2 and 3"):
        cache.same_settings({"a": 1, "b": 2}, {"a": 1, "b": 3})


def test_content_digest_and_masks(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else str(i)) for i in range(50)], "k int, v string")
    one, two = (cache.content_digest(x, ["k"], 7).first() for x in (df, df.repartition(5).select("v", "k")))
    assert one == two and one.rows == 50 and cache.content_digest(df.filter("k > 0"), ["k"], 7).first().digest != one.digest
    assert tuple(cache.content_digest(df.limit(0), ["k"]).first()) == (0, None)
    m = spark.createDataFrame([([0, 1, 1],), ([0, 0],), ([1],), ([],)], "m array<int>")
    assert [[r[0] for r in m.select(cache.window_kept(F.col("m"), p)).collect()] for p in ("any", "all", "majority")] == [[True, False, True, False], [False, False, True, False], [True, False, True, False]]


def test_texts_of_numbers_and_prompts(spark):
    df = spark.createDataFrame([(0, 0), (1023, -5), (1536, 59), (1 << 20, 3661), ((1 << 50) * 3, 360000), (-1, None), (None, 1)], "b bigint, s bigint")
    assert [r[0] for r in df.select(tx.bytes_text(F.col("b"))).collect()] == ["0 B", "1023 B", "1.50 KB", "1.00 MB", "3072.00 TB", "0 B", None]
    assert [r[0] for r in df.select(tx.duration_text(F.col("s"))).collect()] == ["00:00:00", "00:00:00", "00:00:59", "01:01:01", "100:00:00", None, "00:00:01"]
    x = spark.createDataFrame([([0.0, 0.0],), ([1000.0, 0.0],), ([],), (None,)], "x array<double>")
    assert [r[0] for r in x.select(tx.softmax(F.col("x"))).collect()] == [[0.5, 0.5], [1.0, 0.0], [], None]
    q = spark.createDataFrame([(" 问 ", None)], "q string, x string")
    assert q.select(forms.generation_prompt(F.col("q"), F.col("x"), "legacy")).first()[0] == "用户：问\n助手："
    with pytest.raises(ValueError):
        forms.generation_prompt(F.col("q"), F.col("x"), "other")


def test_characters_decoded(spark):
    docs = spark.createDataFrame([(1, "天a😀"), (2, ""), (3, None)], "id int, t string")
    v = tokens.char_vocabulary(docs.filter("t is not null"), "t", 2)
    got = {r.id: r.text for r in tokens.decode_chars(tokens.encode_chars(docs, v, "id", "t"), v, "id").collect()}
    assert len(got[1]) == 3 and got[1].count("�") == 1 and got[2] == got[3] == ""
    t = spark.createDataFrame([([1, 5, 6, 2],), ([1, 2],), (None,)], "t array<int>")
    assert [r[0] for r in t.select(tokens.fit_length(F.col("t"), 3, True)).collect()] == [[1, 5, 2], [1, 2, 0], None]
