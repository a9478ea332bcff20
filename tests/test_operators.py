import random
import zlib

from pyspark.sql import functions as F

from loomery.functions import udfs
from loomery.operators import dedup, joins, profiles, quality, ranking, tokens
from loomery.plans import cleaning, curation, pairs
from loomery.plans import tokens as token_plans


def rows(df):
    return sorted(map(tuple, df.collect()), key=lambda t: tuple((x is None, x) for x in t))


def test_first_wins_and_marks(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "b")], "id int, d string")
    assert [r[0] for r in rows(dedup.first_wins(df, "d", ["id"]))] == [1, 3, 4, 5]
    assert {r.id: r.duplicate for r in dedup.mark_duplicates(df, "d", ["id"]).collect()} == {1: False, 2: True, 3: False, 4: False, 5: False}
    assert dedup.first_wins(df.limit(0), "d", ["id"]).count() == 0


def test_chain_of_near_duplicates_keeps_every_other(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (7, 9)], "a int, b int")
    assert sorted(r[0] for r in dedup.lexicographic_keep(edges).collect()) == [2, 4, 9]


def test_simhash_against_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("甲乙丙丁戊己庚辛") for _ in range(120)) for _ in range(6)]
    texts = [b[:k] + "x" + b[k + 1 :] for b in base for k in (0, 40, 80)] + base + [None, "", "。"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    kept, want = [], {}
    for i, t in enumerate(texts):
        if t is not None:
            h = udfs.simhash_value("".join(c for c in t.lower() if c.isalnum()))
            want[i] = any(((h ^ k) & (2**64 - 1)).bit_count() <= 3 for k in kept)
            if not want[i]:
                kept.append(h)
    got = {r.id: r.duplicate for r in dedup.simhash_near_duplicates(df, "id", "t").collect()}
    assert got == want


def test_blocks_leave_three_equal():
    masks = [m & (2**64 - 1) for m in dedup.block_masks(3)]
    rng = random.Random(1)
    for _ in range(300):
        x = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(not x & m for m in masks)


def test_reason_order_and_bounds(spark):
    p = quality.Policy(min_chars=3, max_chars=20, min_cjk_ratio=0.5).columns()
    df = spark.createDataFrame([("中",), ("中" * 21,), ("abcd",), ("中文字句",), ("中文1111",), ("",)], "t string")
    assert [r[0] for r in df.select(quality.text_reason("t", p)).collect()] == ["too_short", "too_long_after_split", "low_cjk_ratio", None, "low_cjk_ratio", "too_short"]
    early = spark.createDataFrame([(None, "中"), (float("nan"), "中"), (5.0, ""), (5.0, "�")], "s double, t string")
    assert [r[0] for r in early.select(quality.record_reason("s", "t", p)).collect()] == ["score_below_minimum", None, "empty_text_after_clean", "replacement_character"]


def test_cleaning_of_a_small_corpus(spark):
    long = "这是一个比较长的句子，用来看它怎么被切开。" * 40
    data = [(1, "今天天气很好，我们去公园里玩。", "a", 5.0), (2, "今天天气很好。我们去公园里玩", "A ", 5.0), (3, "only English here, nothing else", "a", 5.0), (4, "分数太低的一个句子，不要它。", "a", 1.0), (5, long, "a", 5.0), (6, None, "a", 5.0), (7, "没有来源的句子也有一行结果。", None, 5.0)]
    rec = spark.createDataFrame([(*r, "f", r[0]) for r in data], "record_id bigint, text string, source string, score double, source_file string, source_row bigint")
    pol = spark.createDataFrame([("a", 2.0, 5, 200, 0.3, True, "normalized", 0.5, 0.2, 0.2, 0.45, 0.5)], "source string, " + ", ".join(f"{k} {t}" for k, t in zip(("min_score", "min_chars", "max_chars", "min_cjk_ratio", "normalize_unicode", "dedupe_mode", "max_repeated_line_ratio", "max_url_ratio", "max_html_ratio", "max_punctuation_ratio", "max_digit_ratio"), ("double", "int", "int", "double", "boolean", "string", "double", "double", "double", "double", "double"))))
    got = cleaning.clean_corpus(rec, pol).collect()
    by = {(r.record_id, r.chunk_index): r.reason for r in got}
    assert by[1, 0] is None and by[2, 0] == "duplicate_normalized" and by[3, 0] == "low_cjk_ratio" and by[4, None] == "score_below_minimum"
    assert len([k for k in by if k[0] == 5]) > 2 and not any(k[0] == 6 for k in by) and (7, None) in by or (7, 0) in by
    assert cleaning.clean_corpus(rec.limit(0), pol).count() == 0
    seed = spark.createDataFrame([("今天天气很好我们去公园里玩",)], "t string").select(F.sha2("t", 256).alias("digest"))
    again = {r.record_id: r.reason for r in cleaning.clean_corpus(rec, pol, seed).filter("record_id in (1, 2)").collect()}
    assert set(again.values()) == {"duplicate_against_seed_normalized"}


def test_rank_and_samples(spark):
    df = spark.range(50).selectExpr("id * 7 % 50 as v")
    assert rows(ranking.global_rank(df, ["v"])) == [(i, i) for i in range(50)]
    assert ranking.even_places(10, 3) == [0, 4, 9] and ranking.spaced_places(100, 10)[0] == 5
    assert ranking.hamilton([("a", 5), ("b", 3), ("c", 2)], 5) == {"a": 3, "b": 1, "c": 1}
    assert sum(ranking.hamilton([("a", 5), ("b", 3), ("c", 2)], 7).values()) == 7


def test_source_split_falls_back(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id int, s string")
    got = {r.id: r.split for r in ranking.split_by_source(df, "s", "id", 0.0, 1).collect()}
    assert got == {1: "validation", 2: "validation", 3: "train"}
    got = {r.id: r.split for r in ranking.split_by_source(df, "s", "id", 1.0, 1).collect()}
    assert got == {1: "train", 2: "train", 3: "validation"}


def test_conversations(spark):
    def ask(*turns):
        return "".join(f"<|im_start|>{r}\n{c}<|im_end|>\n" for r, c in turns)

    ok = ask(("user", "你好，请问今天怎么样"), ("assistant", "很好，谢谢你的关心"))
    bad = [ask(("user", "你好")), ask(("assistant", "你好吗你好吗"), ("user", "好的好的")), ask(("user", "一"), ("user", "二三四五六七八九十一二"), ("assistant", "三")), ask(("user", "a"), ("assistant", "b")), "没有标签", None]
    df = spark.createDataFrame([(t,) for t in [ok, *bad]], "t string").select(curation.normalize_messages(curation.parse_chat("t")).alias("m"))
    got = [r[0] for r in df.select(curation.structural_reason(F.col("m"))).collect()]
    assert got[:5] == [None, "too_few_messages", "does_not_end_assistant", "roles_not_alternating", "too_short"]
    r = df.limit(1).select(curation.chatml(F.col("m")).alias("t"), curation.label_mask(F.col("m")).alias("k")).first()
    assert len(r.t) == len(r.k) and "".join(c for c, k in zip(r.t, r.k) if k == "1") == "很好，谢谢你的关心<|im_end|>"


def test_percentile_rules(spark):
    df = spark.createDataFrame([("a", v) for v in (1, 2, 3, 4)] + [("b", 9)], "k string, v int")
    floor = {r.k: r.p for r in profiles.rank_percentiles(df, ["k"], "v", {"p": 0.5}, "floor").collect()}
    near = {r.k: r.p for r in profiles.rank_percentiles(df, ["k"], "v", {"p": 0.5}, "round").collect()}
    assert floor == {"a": 3, "b": 9} and near == {"a": 3, "b": 9}


def test_window_starts_and_union(spark):
    df = spark.createDataFrame([(9,), (10,), (14,), (16,), (0,)], "n int").select("n", profiles.window_starts(F.col("n"), 10, 8).alias("s"))
    assert {r.n: r.s for r in df.collect()} == {9: [], 10: [0], 14: [0, 4], 16: [0, 6], 0: []}
    w = spark.createDataFrame([(1, 0, 10), (1, 5, 12), (1, 20, 25), (1, 21, 23)], "k int, a int, b int")
    assert rows(profiles.interval_union(w, ["k"], "a", "b")) == [(1, 4, 17, 24)]


def test_packing(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([5, 7, 3, 25, 0, 2])], "id int, n int")
    got = tokens.first_fit(df, "id", "n", F.lit(0), 10).collect()
    assert sum(r.n for r in got) == 42
    used = {}
    for r in got:
        used[r.window] = used.get(r.window, 0) + r.n
    assert max(used.values()) <= 10 and len([r for r in got if r.id == 3]) == 3
    assert rows(tokens.running_starts(df, "id", "n").select("id", "start")) == [(0, 0), (1, 5), (2, 12), (3, 15), (4, 40), (5, 40)]


def test_asof_lookup_and_trees(spark):
    a = spark.createDataFrame([("x", 5), ("x", 1), ("y", 9)], "k string, t int")
    b = spark.createDataFrame([("x", 2, "p"), ("x", 5, "q"), ("x", 7, "r")], "k string, u int, v string")
    assert rows(joins.asof(a, b, ["k"], "t", "u", ["v"])) == [("x", 1, None), ("x", 5, "q"), ("y", 9, None)]
    s = spark.createDataFrame([(0, 100, "a"), (100, 8900, "b"), (9000, 2, "c"), (9000, 0, "none")], "s bigint, n bigint, d string")
    p = spark.createDataFrame([(0,), (99,), (100,), (5000,), (9001,), (9002,)], "p bigint")
    assert rows(joins.position_lookup(p, s, "p", "s", "n", "d", 64)) == [(0, "a"), (99, "a"), (100, "b"), (5000, "b"), (9001, "c"), (9002, None)]
    n = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, None), (5, 6), (6, 5)], "id int, up int")
    assert rows(joins.tree_paths(n, "id", "up")) == [(1, 1, 0), (2, 1, 1), (3, 1, 2), (4, 4, 0)]


def test_newest_decision_and_merge(spark):
    dec = spark.createDataFrame([(1, 10, True, "new", "2025-01-02"), (2, 10, True, "old", "2025-01-01"), (3, 11, False, "no", "2025-01-01"), (4, 99, True, "x", None)], "decision_id bigint, pair_id bigint, accepted boolean, candidate string, decided_at string")
    own = spark.createDataFrame([(10, "t"), (11, "u"), (12, None)], "pair_id bigint, target string")
    assert rows(pairs.keyed_merge(own, dec).select("pair_id", "target", "changed")) == [(10, "new", True), (11, "u", False), (12, None, False)]


def test_wilson_and_calibration(spark):
    low, high = profiles.wilson(F.lit(5), F.lit(10))
    r = spark.range(1).select(low.alias("a"), high.alias("b"), profiles.wilson(F.lit(0), F.lit(0))[0].alias("c")).first()
    assert round(r.a, 4) == 0.2366 and round(r.b, 4) == 0.7634 and r.c is None
    df = spark.createDataFrame([(0.95, True), (0.85, False), (1.2, True)], "c double, ok boolean")
    assert profiles.calibration_error(df, "c", "ok").first()[0] == round((0.05 + 0.85) / 3, 9)


def test_all_evaluation_sources_are_audited(spark, tmp_path):
    a, b = "河水在清晨缓缓流过古老的石桥，岸边的渔夫收起昨夜撒下的渔网准备回家", "图书馆从下个月开始延长开放时间，读者可以在晚上继续使用二楼的自习室"
    data = [(1, "train", a), (2, "Train ", b), (3, "train", b), (101, "validation", a + "。"), (102, "test", b), (103, None, b[:-1]), (104, "test", "完全不同的一段话，没有任何地方和别处相同"), (105, "test", None), (200, "Test", b)]
    spark.createDataFrame(data, "pair_id bigint, split string, source string").write.parquet(f"{tmp_path}/pair_records.parquet")
    got = {r.pair_id: (r.best_id, r.jaccard) for r in cleaning.anchor_jaccard_near_dup(spark, str(tmp_path)).collect()}
    assert set(got) == {101, 102, 103, 200} and got[101] == (1, 1.0) and got[102] == got[200] == (2, 1.0)
    assert got[103][0] == 2 and 0.85 <= got[103][1] < 1


def test_anchor_overlap_against_brute_force(spark):
    rng = random.Random(8)
    base = ["".join(rng.choice("甲乙丙丁戊己庚辛壬癸子丑寅卯") for _ in range(n)) for n in (3, 5, 30, 60, 120)]
    texts = [t[:k] + rng.choice(["", "x", "yz"]) + t[k + rng.randint(0, 1) :] for t in base for k in (rng.randrange(len(t)) for _ in range(12))]
    ask, held = list(enumerate(texts[::2])), list(enumerate(texts[1::2], 1000))

    def grams(t):
        return {t[i : i + 4] for i in range(len(t) - 3)} or {t}

    def low(t):
        return set(sorted({zlib.crc32(g.encode()) for g in grams(t)})[:12])

    want = {}
    for i, t in ask:
        near = [(round(len(grams(t) & grams(u)) / len(grams(t) | grams(u)), 9), -k) for k, u in held if low(t) & low(u)]
        if near and max(near)[0] >= 0.85:
            want[i] = (-max(near)[1], max(near)[0])
    df = [spark.createDataFrame(x, "id int, t string") for x in (ask, held)]
    got = {r.id: (r.best_id, r.jaccard) for r in dedup.anchor_overlap(*df, "id", "id", "t", "t").collect()}
    assert got == want and len({j for _, j in want.values()}) > 3


def test_every_character_has_its_id(spark, tmp_path):
    many = "".join(map(chr, range(0x4E00, 0x4E00 + 700))) + "😀e\u0301\n"
    spark.createDataFrame([(1, many), (2, ""), (3, None), (4, "一一😀")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n, r.unknown) for r in token_plans.char_encoding(spark, str(tmp_path)).collect()}
    assert got == {1: (706, 0), 2: (2, 0), 4: (5, 0)}
    docs = spark.createDataFrame([(1, "bab"), (2, None), (3, "b😀?")], "id int, t string")
    vocabulary = tokens.char_vocabulary(docs.filter("id < 3"), "t", None)
    assert {r.id: r.tokens for r in tokens.encode_chars(docs, vocabulary, "id", "t").collect()} == {1: [1, 4, 5, 4, 2], 2: [1, 2], 3: [1, 4, 3, 3, 2]}


def test_simhash_query_gives_the_members(spark, tmp_path):
    spark.createDataFrame([(5, "河水在清晨缓缓流过古老的石桥"), (7, "河水在清晨，缓缓流过古老的石桥。"), (8, None)], "record_id bigint, text string").write.parquet(f"{tmp_path}/text_records.parquet")
    got = cleaning.simhash_near_dup(spark, str(tmp_path)).select("record_id", "class_id", "duplicate")
    assert rows(got) == [(5, 5, False), (7, 5, True)]
