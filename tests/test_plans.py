import __spark_entry__ as entry
import pytest
from pyspark.sql import functions as F

from loomery import catalog
from loomery.functions import forms
from loomery.plans import evaluation


def plan(df):
    return df._jdf.queryExecution().toString()


def test_entry_and_catalog(spark):
    assert entry.entry(spark).count() > 0
    known = entry.queries()
    assert set(catalog.queries()) <= set(known) and set(entry.oracle_sql()) <= set(known)


def test_top_per_group_is_limited_before_the_shuffle(spark, sf):
    p = plan(catalog.queries()["hash_topk_per_source"](spark, sf))
    assert p.index("WindowGroupLimit") > 0 and "CartesianProduct" not in p


def test_columns_are_pruned_and_filters_pushed(spark, sf):
    p = plan(catalog.queries()["merged_targets"](spark, sf))
    read = [x for x in p.splitlines() if "ReadSchema" in x]
    assert read and not any("origin" in x.split("ReadSchema")[1] or "added_at" in x.split("ReadSchema")[1] for x in read)
    assert "IsNotNull(pair_id)" in p


@pytest.mark.parametrize("name", ["clean_reject_report", "pair_issue_report", "scenario_coverage", "anchor_jaccard_near_dup"])
def test_no_cross_joins(spark, sf, name):
    p = plan(catalog.queries()[name](spark, sf))
    assert "CartesianProduct" not in p


def test_forms(spark):
    df = spark.createDataFrame([("今 天 天 气 ， 好", "Use exactly two sentences.")], "a string, b string")
    r = df.select(forms.detokenized(F.col("a")).alias("d"), forms.obeys("b", F.lit("One. Two.")).alias("y"), forms.obeys("b", F.lit("One.")).alias("n"), forms.source_target(F.lit(" s "), F.lit("t")).alias("x"), forms.source_target(F.lit("简写："), F.lit("t")).alias("z")).first()
    assert r.d == "今天天气，好" and r.y and not r.n and tuple(r.x) == ("s简写：t", "00001") and r.z is None
    assert forms.plan_value("一二三。四五六。\n\n七八九。", 6) == ["一二三。", "四五六。\n\n", "七八九。"]
    assert "".join(forms.plan_value("很长的句子没有停顿" * 5, 7)) == "很长的句子没有停顿" * 5
    assert not forms.obeys_value('Do not use "red".', "Red car") and forms.obeys_value("all lowercase please", "abc")


def test_choices(spark):
    df = spark.createDataFrame([(1, [0.1, 0.9], 1), (2, [0.5, 0.5], 0), (3, [0.2, 0.8], 0)], "id int, s array<double>, a int")
    assert [r.correct for r in evaluation.choose(df, "s", "a").orderBy("id").collect()] == [True, True, False]
    got = {r.id: r.picked for r in evaluation.mean_centred(df, "id", "s", "a").collect()}
    assert got == {1: 1, 2: 0, 3: 1}
