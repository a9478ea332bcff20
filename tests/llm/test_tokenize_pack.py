import numpy as np
import pytest
from pyspark.sql import functions as F

from loomery.llm import bpe, packing, tokenize

TEXTS = ["it's ''s I'll've", "  a  b\n\n c\t", "中文，Abc 123½", "<|endoftext|>x", "", "   ", "é😀", "\n's 's"]


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.ranks_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda xs: [e.ids for e in t.encode_batch(xs, add_special_tokens=False)]


def test_ids_equal_the_library(spark, reference):
    df = spark.createDataFrame([*enumerate(TEXTS), (99, None)], "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = {r.doc_id: r.ids for r in tokenize.encode_corpus(df).collect()}
    assert [got[i] for i in range(len(TEXTS))] == reference(TEXTS) and got[99] == []
    back = {r.doc_id: r.text for r in tokenize.decode_corpus(tokenize.encode_corpus(df, offsets=True)).collect()}
    assert [back[i] for i in range(len(TEXTS))] == TEXTS
    assert tokenize.encode_corpus(df.limit(0)).count() == 0


def test_random_texts(reference):
    hypothesis = pytest.importorskip("hypothesis")
    st = hypothesis.strategies
    enc = bpe.encoder(bpe.ranks_path())

    @hypothesis.settings(max_examples=150, deadline=None)
    @hypothesis.given(st.lists(st.text(st.sampled_from("ab 's tre\n\t1中，-!llvedm　é"), max_size=40), max_size=4))
    def same(texts):
        ids, at, offsets = enc.encode(texts)
        assert enc.decode(ids, at, offsets) == texts
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == reference(texts)
        assert enc.count(texts).tolist() == [len(x) for x in reference(texts)]

    same()


def test_long_text(reference):
    text = "很长的文字，a b " * 20_000
    enc = bpe.encoder(bpe.ranks_path())
    ids, at, offsets = enc.encode([text])
    assert enc.decode(ids, at, offsets) == [text]
    with pytest.raises(ValueError):
        enc.decode(ids, at, offsets + np.arange(len(offsets)))
    assert ids.tolist() == reference([text])[0]


def test_scan_is_a_run_of_the_automaton(monkeypatch):
    rng = np.random.default_rng(2)
    table, codes = rng.integers(0, 5, (7, 5)).astype(np.uint8), rng.integers(0, 7, 4000)
    want, s = [], 3
    for c in codes:
        want.append(s)
        s = table[c, s]
    for block in (2, 7, 256):
        monkeypatch.setattr(bpe, "BLOCK", block)
        assert bpe._scan(codes, table, 3).tolist() == [int(x) for x in want]


def test_items_of_a_source_are_spread():
    rng = np.random.default_rng(4)
    size, source = rng.integers(1, 60, 3000), np.where(np.arange(3000) % 3 == 0, "hot", np.arange(3000).astype(str))
    where = packing.pack(size, np.arange(3000), source.astype(object), 256)
    used, hot = np.bincount(where, weights=size), np.bincount(where[source == "hot"])
    least = -(-int(size.sum()) // 256)
    assert used.max() <= 256 and len(used) <= 1.01 * least and (hot > packing.SOURCE_SLACK * -(-1000 // least)).mean() <= 0.04


def test_pack_rules():
    rng = np.random.default_rng(1)
    size = rng.integers(0, 100, 500)
    cluster = np.where(np.arange(500) < 160, 7, np.arange(500) + 1000)
    where = packing.pack(size, cluster, np.array(["s"] * 500, object), 100)
    used = np.bincount(where, weights=size)
    assert used.max() <= 100 and used.sum() == size.sum()
    least = -(-int(size.sum()) // 100)
    most = -(-160 // least)
    for b in np.unique(where):
        assert ((where == b) & (cluster == 7) & (size > 0)).sum() <= most
    assert packing.pack(size[:0], cluster[:0], np.array([], object), 10).tolist() == []


def test_hot_copies_still_fill_containers():
    size = np.full(300, 10)
    where = packing.pack(size, np.zeros(300, np.int64), np.array(["s"] * 300, object), 100)
    assert len(np.unique(where)) == 30


def test_pack_texts(spark):
    docs = spark.createDataFrame([(i, "word " * i, None) for i in range(40)] + [(100, None, "s"), (101, "", "s"), (3, "word " * 3, "s")], "doc_id bigint, text string, source string").withColumn("capacity", F.lit(1))
    kinds = spark.createDataFrame([("a", 16), ("b", 64), ("bad", None), ("none", 0)], "container string, capacity int")
    got = packing.pack_texts(docs, kinds).toPandas()
    n = tokenize.count_tokens(docs).toPandas().groupby("doc_id")["n_tokens"].sum()
    for kind, cap in (("a", 16), ("b", 64)):
        own = got[got.container == kind]
        assert own.groupby("bin_id")["n_tokens"].sum().max() <= cap
        assert (own.groupby("doc_id")["n_tokens"].sum() == n).all()
        split = own.groupby("doc_id").size()
        single = [d for d in n.index if n[d] <= cap and d != 3]
        assert (split[single] == 1).all()
    assert set(got.container) == {"a", "b"}
    assert packing.pack_texts(docs.limit(0), kinds).count() == 0
