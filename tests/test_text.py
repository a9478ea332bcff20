import pytest
from pyspark.sql import functions as F

from loomery.functions import text as tx
from loomery.functions import udfs


def one(spark, value, col, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(col.alias("r")).first()[0]


def test_clean_text(spark):
    raw = "第一句。" + chr(0x200B) + "  第二句！\r\n\r\n  第三句？" + chr(7) + chr(0x3000)
    assert one(spark, raw, tx.clean_text("t")) == "第一句。 第二句！\n第三句？"
    assert one(spark, None, tx.clean_text("t")) is None
    assert one(spark, " \r\n\t ", tx.clean_text("t")) == ""


@pytest.mark.parametrize("a, b", [("Ab, C_1!", "abc1"), ("", ""), ("。，", "")])
def test_dedupe_form(spark, a, b):
    assert one(spark, a, tx.dedupe_form("t")) == b


def test_ratios(spark):
    assert one(spark, "中a 1", F.round(tx.cjk_ratio("t"), 6)) == 0.333333
    assert one(spark, "", tx.cjk_ratio("t")) == 0
    assert one(spark, "a\na\na\nb", tx.repeated_line_ratio("t")) == 0.5
    assert one(spark, "a\na\na", tx.repeated_line_ratio("t")) == 0
    assert one(spark, "x http://a.b y", F.round(tx.url_ratio("t"), 6)) == round(10 / 14, 6)


def test_ngrams_of_short_texts(spark):
    assert one(spark, "abc", tx.char_ngrams("t", 4)) == []
    assert one(spark, "abc", tx.char_ngrams("t", 4, whole_if_short=True)) == ["abc"]
    assert one(spark, "", tx.char_ngrams("t", 4, whole_if_short=True)) == []
    assert one(spark, "abcde", tx.char_ngrams("t", 4)) == ["abcd", "bcde"]
    assert one(spark, None, tx.char_ngrams("t", 4)) is None


def test_numbers_as_multisets(spark):
    a, b = tx.numbers(F.lit("3 and 3, 20%")), tx.numbers(F.lit("3 and 20%"))
    assert one(spark, "", tx.numbers_kept(b, a)) and not one(spark, "", tx.numbers_kept(a, b))
    assert one(spark, "", tx.multiset_overlap(a, b)) == 2


def test_hash_mod_is_that_of_the_digest(spark):
    import hashlib

    want = int(hashlib.sha256("组1".encode()).hexdigest()[:16], 16) % 1_000_000
    assert one(spark, "组1", tx.hash_mod(F.col("t"), 1_000_000)) == want


def test_chunks_and_sentences():
    text = "一二三四五。六七八九十，" * 30
    got = udfs.split_chunks(text, 50, 10)
    assert all(10 <= len(x) <= 50 for x in got) and "".join(got) == text
    assert udfs.split_chunks("短", 50, 10) == [] and udfs.split_chunks("", 50, 0) == [""]
    s = "价格是9.2元。e.g. 砂石。“好！”他说……又来。End. Next"
    assert "".join(udfs.split_sentences_value(s)) == s
    assert udfs.split_sentences_value("A b. C")[0] == "A b. "
    assert udfs.utf8_parts_value("中文ab", 4) == ["中", "文a", "b"]


def test_pair_metrics():
    assert udfs.lcs_length("abcde", "ace") == 3 and udfs.lcs_length("", "a") == 0
    assert udfs.rouge_l_value("", "") == 1 and udfs.rouge_l_value("a", "") == 0
    assert udfs.chrf_value("同样", "同样") == pytest.approx(1) and udfs.chrf_value("", "") == 1
    assert udfs.simhash_value("") == -1


def test_udf_takes_nulls(spark):
    assert one(spark, None, udfs.nfkc("t")) is None and one(spark, "Ａ", udfs.nfkc("t")) == "A"
