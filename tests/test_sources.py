import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from loomery.sources import readers, sinks
from loomery.streaming import incremental


def test_jsonl_tolerant_and_strict(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes("﻿".encode() + b'{"text": "x", "id": "1"}\n\n{bad\n[1]\n{"text": null}\n')
    got = [(r.text, r.reason) for r in readers.jsonl(spark, str(tmp_path / "a.jsonl"), "text string, id string").collect()]
    assert got == [("x", None), (None, "blank_line"), (None, "invalid_json"), (None, "not_an_object"), (None, None)]
    with pytest.raises(Exception, match="bad line"):
        readers.jsonl(spark, str(tmp_path / "a.jsonl"), "text string", strict=True).collect()


def test_parquet_provenance(spark, tmp_path):
    spark.createDataFrame([("a", "s", "4.5"), (None, "s", "1"), ("b", None, "x")], "text string, source string, score string").coalesce(1).write.parquet(str(tmp_path / "p"))
    got = sorted((r.text, r.source, r.score, r.source_row) for r in readers.parquet_records(spark, str(tmp_path / "p")).collect())
    assert got == [("a", "s", 4.5, 0), ("b", "unknown", float("-inf"), 2)]
    with pytest.raises(KeyError, match="nope"):
        readers.parquet_records(spark, str(tmp_path / "p"), text="nope")


def test_units_arrays_and_layouts(spark, tmp_path):
    (tmp_path / "t.txt").write_text("a\nb\n\n \nc\n")
    assert sorted(r.text for r in readers.text_units(spark, str(tmp_path / "t.txt"), "blankline").collect()) == ["a\nb", "c"]
    assert readers.text_units(spark, str(tmp_path / "t.txt")).count() == 3
    (tmp_path / "o.json").write_text(json.dumps({"n": 1, "rows": [{"a": "x"}, {"a": "y"}]}))
    assert sorted(r.a for r in readers.json_array(spark, str(tmp_path / "o.json"), "a string").collect()) == ["x", "y"]
    (tmp_path / "l.jsonl").write_text('{"text": "t"}\n{"instruction": "i", "input": "n", "output": "o"}\n{"conversations": [{"from": "user", "value": "v"}]}\n')
    df = readers.jsonl(spark, str(tmp_path / "l.jsonl"), readers.LAYOUT)
    assert [r[0] for r in df.select(readers.layout_text(df)).collect()] == ["t", "i\nn\no", "user: v"]


def test_archives_and_nested_sets(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("d/a.json", "1")
        z.writestr("b.txt", "2")
    (tmp_path / "m.json").write_text("3")
    with tarfile.open(tmp_path / "t.tar.gz", "w:gz") as t:
        t.add(tmp_path / "m.json", "m.json")
    assert sorted(r.content for r in readers.archive_members(spark, f"{tmp_path}/*z*", ".json").collect()) == ["1", "3"]
    doc = {"data": [{"title": "t", "paragraphs": [{"context": "ab", "qas": [{"id": "1", "question": "q", "answers": [{"text": "a", "answer_start": 0}]}, {"id": "2", "question": "q", "answers": [{"text": "z", "answer_start": 0}]}]}]}]}
    assert [r.id for r in readers.squad(spark.createDataFrame([(json.dumps(doc),)], "j string"), "j").collect()] == ["1"]
    tree = {"role": "prompter", "text": "q", "replies": [{"role": "assistant", "text": "bad", "rank": 1, "message_id": "b"}, {"role": "assistant", "text": "good", "rank": 0, "message_id": "a", "replies": [{"role": "prompter", "text": "more"}]}]}
    got = readers.reply_paths(spark.createDataFrame([(json.dumps(tree),), (None,)], "j string"), "j").collect()
    assert [m.content for m in got[0].messages] == ["q", "good"] and got[1].messages == []
    r = spark.range(1).select(readers.newest_edit(F.array(F.lit("a"), F.lit("b"), F.lit("")), F.lit("o")).alias("e"), readers.parity_dialogue(F.array(F.lit("x"), F.lit("y"))).alias("p")).first()
    assert r.e == "b" and [m.role for m in r.p] == ["user", "assistant"]


def test_shards_and_manifest(spark, tmp_path):
    df = spark.range(10).coalesce(1)
    m = sinks.write_shards(df, str(tmp_path / "s"), 4)
    assert sorted(r.rows for r in m.collect()) == [2, 4, 4]
    assert {r.state for r in sinks.verify(spark, str(tmp_path / "s"), m).collect()} == {"same"}
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_shards(df, str(tmp_path / "s"), 4)
    assert sorted((r.id, r.shard, r.place) for r in sinks.sequential_shards(df, ["id"], 4).collect())[5] == (5, 1, 1)
    assert [r.part for r in sinks.round_robin(df, ["id"], 3).orderBy("id").collect()][:4] == [0, 1, 2, 0]


def test_stream_drops_what_was_seen(spark, tmp_path):
    d = tmp_path / "in"
    spark.createDataFrame([("A b",), ("c",)], "text string").write.parquet(str(d))
    for _ in range(2):
        s = spark.readStream.schema("text string").parquet(str(d))
        incremental.seeded_batches(s, "text", str(tmp_path / "seen"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        spark.createDataFrame([("a B!",), ("d",)], "text string").write.mode("append").parquet(str(d))
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["A b", "c", "d"]
