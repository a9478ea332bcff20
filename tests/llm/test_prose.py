import random

import numpy as np
import pytest

from loomery.llm import prose, textstats


@pytest.fixture(scope="module")
def lex(spark):
    words = spark.read.parquet("/root/testdata/sf0.01/common_words.parquet")
    return textstats.Lexicon(frozenset(r[0].lower() for r in words.select("token").distinct().collect()))


def labelled(seed=3):
    """Texts of known kinds that are neither examples nor test data."""
    rng = random.Random(seed)
    nouns = "雨伞 书签 锅盖 风筝 竹篮 围巾 哨子 台历 油灯 剪刀 badge rope candle basket lantern mirror".split()
    said = ["他在院子里种了两棵树，每天早上都要去看一看。", "如果明天不下雨，我们就把这批书送到学校去。", "The old man was not in his house, and we could not find the key.", "她说这条路很长，但是大家都愿意走下去。", "They have more than one reason to be here, but none of it is new."]
    out = []
    for _ in range(60):
        n = rng.randint(5, 14)
        out.append(("prose", "".join(rng.choice(said) for _ in range(n)) if rng.random() < 0.7 else "\n".join("".join(rng.choice(said) for _ in range(3)) for _ in range(n // 2))))
        mark = rng.choice(["- {}", "• {}", "{i}. {}", "({i}) {}", "{}"])
        out.append(("list", "\n".join(mark.format(rng.choice(nouns), i=i + 1) for i in range(n))))
        sep = rng.choice([" | ", "\t", ","])
        out.append(("table", "\n".join(sep.join([rng.choice(nouns), str(rng.randint(1, 9999)), f"{rng.randint(1, 99)}%", rng.choice(nouns)]) for _ in range(n))))
        out.append(("junk", rng.choice(["".join(rng.choice("#$%^&*~=+") for _ in range(n * 20)), "哈" * (n * 12), ("".join(rng.choice(said) for _ in range(n))).encode().decode("latin-1"), "%064x" % rng.getrandbits(256) * n])))
    return out


def test_rounds_of_em_pay(spark, lex):
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.01/text_records.parquet").select("text").filter("text is not null and trim(text) <> ''").collect()]
    own = labelled()
    x = textstats.batch_stats(texts + [t for _, t in own], lex)[1]
    centre, scale = x.mean(0), np.sqrt(np.maximum(x.var(0), 1e-4))
    z = (x - centre) / scale
    held = z[len(texts) :]
    examples, kinds = prose.example_stats(lex)
    score, fit = {}, {}
    for rounds in (0, None):
        right, likely = [], []
        for seed in range(1, 7):
            mix = prose.start_mixture(z, k=24, seed=seed, rounds=rounds)
            named = prose.name_components(mix, (examples - centre) / scale, kinds)
            right.append(np.mean([named[c] == k for c, (k, _) in zip(mix.density(held).argmax(1), own)]))
            likely.append(mix.expect(z)[-1] / len(z))
        score[rounds], fit[rounds] = np.mean(right), np.mean(likely)
    assert fit[None] > fit[0] + 1 and score[None] > score[0] + 0.02, (fit, score)


def test_likelihood_never_falls(lex):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(m, 1, (200, 3)) for m in (0, 4, 9)])
    mix, old = prose.start_mixture(x, k=5, rounds=0), -np.inf
    for _ in range(15):
        sums = mix.expect(x)
        assert sums[-1] >= old - 1e-6
        mix, old = mix.maximize(sums), sums[-1]
    assert len(prose.spread_rows(np.ones((7, 3)), 5, rng)) == 1


def test_statistics_of_a_batch_are_those_of_each_text(lex):
    texts = [t for _, t in labelled(5)[:40]] + ["", " \n", "。", "a", "<p>你好</p>\n<li>x</li>", "甲​乙\r\n丙", '{"a": 1, "b": "x"}', "x" * 5000, "�" * 60]
    basic, more = textstats.batch_stats(texts, lex)
    assert np.isfinite(basic).all() and np.isfinite(more).all()
    for i, t in enumerate(texts):
        b, m = textstats.batch_stats([t], lex)
        assert np.allclose(b[0], basic[i]) and np.allclose(m[0], more[i]), t


def test_basic_statistics(lex):
    basic, more = textstats.batch_stats(["今天的天气很好。\n我们在公园", "The cat is on a mat.", "1. 毛巾\n2. 水杯"], lex)
    got = [dict(zip(textstats.BASIC, b)) for b in basic]
    assert got[0]["n_words"] == 12 and got[0]["line_end_share"] == 0.5 and got[0]["han_share"] == pytest.approx(12 / 13) and got[0]["common_word_share"] > 0.2
    assert got[1]["n_words"] == 6 and got[1]["mean_word_length"] == pytest.approx(14 / 6) and got[1]["common_word_share"] == pytest.approx(4 / 6)
    assert dict(zip(textstats.MORE, more[2]))["marked"] == 1
