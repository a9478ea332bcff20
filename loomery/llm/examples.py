"""Inspected examples of prose, lists, tables and junk, by family. The mixture doesn't begin at them: they name its components."""

from __future__ import annotations

import random

_rng = random.Random(11)
_NOUNS = "毛巾 水杯 扫帚 灯泡 电池 雨衣 粉笔 门锁 花生 茶叶".split()
_PLACES = "窗帘轨道 合唱曲谱 露营炉具 邮票图册 木工夹具 陶艺泥料 自行车铃 缝纫机针".split()
_THINGS = "steel kettle;paper folder;garden rope;oak bench;spare filter;blue ladder;large hinge;travel basket".split(";")
_NEWS = "根据气象台3月9日公布的数据，今年的降雨量比去年多了12.5%，这对附近的农户来说是一个好消息。工作人员正在检查河边的水位，并且要求居民注意安全。从目前的情况来看，这项工作还要继续一个月。"
_TALE = "小猫把糖给了小狗，小狗很高兴。天黑了，妈妈在家里做饭。“你在哪里？”爸爸问。大家都来帮忙，小鸟也来了。"
_LAW = "凡因合同所生之争议，除另有约定外，应依侵权责任之法理予以认定，并不以过错的成立为要件。就此而言，因果关系乃责任成立的必要而非充分条件，其证明难以由单一样本完成。"
_EN = "The library said on 4 May that the night bus will serve 300 more readers this year. Most of them want the town to repair the bridge before winter, but the council has not decided if it can pay for the work."
_EN_TALE = "The dog ran to the shop. Mum was happy, and the hen was happy too. Where is the book? It is in the house."
_EN_PAPER = "We operationalise the latent construct as a stochastic functional of institutional context, thereby obviating recourse to conjecture. The estimator converges only insofar as the regularity condition is satisfied."
_TRAD = "根據氣象臺3月9日公布的數據，今年的降雨量比去年多了12.5%，這對附近的農戶來說是一個好消息。工作人員正在檢查河邊的水位，並且要求居民注意安全。"


def _lines(form, n=12, of=_NOUNS, head=""):
    return head + "\n".join(form(i, _rng.choice(of)) for i in range(1, n + 1))


def _cell():
    return _rng.choice([str(_rng.randint(3, 9999)), f"{_rng.randint(1, 99)}.{_rng.randint(1, 9)}%", _rng.choice(_PLACES), "北渡口", f"{_rng.randint(1, 12)}月{_rng.randint(1, 28)}日", f"QX{_rng.randint(100, 999)}"])


def _grid(sep, rows=9, cols=5, left="", right=""):
    return "\n".join(left + sep.join(_cell() for _ in range(cols)) + right for _ in range(rows))


def _fields(sep, end, names=("名称", "产地", "库位", "编号", "数量", "登记日", "说明")):
    values = ("合唱曲谱5143", "北渡口", "南二架", "QX413", "3204册", "2025-04-16", "每季翻晒一次以防受潮")
    return end.join(f"{k}{sep}{v}" for k, v in zip(names, values))


def _wrap(text, width):
    return "\n".join(text[i : i + width] for i in range(0, len(text), width))


def _random_words(n):
    return " ".join("".join(_rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(_rng.randint(2, 12))) for _ in range(n))


def _noise(n, of="_$%□-~+*#!★&;|\\=./◆:■@^<>?"):
    return "".join(_rng.choice(of) for _ in range(n))


def _lost(text, share):
    """A text read with another coding: characters out of order, many of them replaced."""
    mixed = _rng.sample(text, len(text))
    return "".join("\ufffd" if _rng.random() < share else c for c in mixed if c not in "，。")


_EN_NAMES = ("name", "origin", "shelf", "code", "amount", "logged", "remark")
EXAMPLES: list[tuple[str, list[str]]] = [
    ("prose", [_NEWS, _NEWS + "\n" + _NEWS[:60] + "。", "# 简介\n" + _NEWS]),
    ("prose", [_TALE, _TALE + "\n" + _TALE, _TALE[:25]]),
    ("prose", [_LAW, _LAW + "\n" + _LAW, _LAW.replace("，", "、")]),
    ("prose", [_EN, _EN + "\n" + _EN_TALE, _EN.upper()]),
    ("prose", [_EN_TALE, _EN_TALE + "\n" + _EN_TALE]),
    ("prose", [_EN_PAPER, _EN_PAPER + "\n" + _EN_PAPER, "# 摘要\n" + _EN_PAPER]),
    ("prose", [_TRAD, _TRAD + "\n" + _TRAD]),
    ("prose", [_wrap(_NEWS, 24), _wrap(_NEWS + _LAW, 36), _wrap(_TALE + _TALE, 24)]),
    ("prose", ["<p>" + _NEWS + "</p>\n<p>" + _LAW + "</p>", '<div class="c">' + _TALE + "<br/>\n" + _TALE + "</div>"]),
    ("prose", ["—" + _NEWS[:46] + "。\n甲：这里的邮票图册建成已有20年，近几年才开始检查。\n乙：目前很难一次把河道清理到位。\n“我们希望大家都能看到这些图册。”", "甲：" + _NEWS[:46] + "。\n乙：" + _LAW[:40] + "。"]),
    ("prose", ["小猫在哪里？爸爸问\n这是小马的灯，它是白白的\n大家都来帮忙，小鸟也来了\n小猫很高兴\n晚上我们吃饭，吃了饭就去田里\n妈妈笑了", "他们去了河边\n天气很好，太阳出来了\n小狗跑啊跑，跑到家里，坐下来，很累\n姐姐说：你看，花真好"]),
    ("prose", [_EN.replace(" ", "        "), _EN_TALE.replace(" ", "    ")]),
    ("list", [_lines(lambda i, x: f"• {x}"), _lines(lambda i, x: f"- {x}", head="材料清单\n"), _lines(lambda i, x: f"* {x}")]),
    ("list", [_lines(lambda i, x: f"{i}. {x}"), _lines(lambda i, x: f"（{i}）{x}；"), _lines(lambda i, x: f"{i})灌{x}。", head="用品一览：\n")]),
    ("list", [_lines(lambda i, x: f"步骤{i} 检查{x}", of=_PLACES), _lines(lambda i, x: f"[{'x' if i % 3 else ' '}] 更新{x}", of=_PLACES), _lines(lambda i, x: f"【更新{x}】", of=_PLACES)]),
    ("list", [_lines(lambda i, x: x), _lines(lambda i, x: f"检查{x}", of=_PLACES), _lines(lambda i, x: x, head="器材名单\n")]),
    ("list", [_lines(lambda i, x: f"{x}×{i * 371}"), _lines(lambda i, x: f"{i}. {x}（{i * 713}）"), _lines(lambda i, x: f"• {x} {i * 97}")]),
    ("list", [_lines(lambda i, x: f"{i}. {x}", of=_THINGS), _lines(lambda i, x: f"- {x}", of=_THINGS), _lines(lambda i, x: f"[x] {x} {i * 87}", of=_THINGS)]),
    ("list", [_lines(lambda i, x: x, of=_THINGS), _lines(lambda i, x: f"{x}×{i * 87}", of=_THINGS)]),
    ("list", ["\n".join("、".join(_rng.choice(_NOUNS) for _ in range(7)) for _ in range(4)), "、".join(_rng.choice(_NOUNS) for _ in range(22)), ", ".join(_rng.choice(_THINGS) for _ in range(18))]),
    ("table", [_grid(" | ", left="| ", right=" |"), "| 名称 | 数量 |\n| --- | --- |\n" + _grid(" | ", cols=2, left="| ", right=" |")]),
    ("table", [_grid("\t"), _grid("\t", rows=14, cols=4)]),
    ("table", [_grid(","), "名称,数量,地点,日期,备注\n" + _grid(","), _grid(";")]),
    ("table", [_grid("        ", cols=4), _grid("    ", rows=12, cols=5)]),
    ("table", ["<table>" + "\n".join("<tr>" + "".join(f"<td>{_cell()}</td>" for _ in range(4)) + "</tr>" for _ in range(7)) + "</table>"]),
    ("table", [_fields("：", "\n"), _fields(": ", " \n"), _fields("：", "\n", _EN_NAMES)]),
    ("table", [_fields("=", "；"), _fields(" = ", "; "), _fields("=", ";", _EN_NAMES)]),
    ("table", ['{"' + _fields('": "', '", "') + '"}', '{\n  "' + _fields('": "', '",\n  "', _EN_NAMES) + '"\n}']),
    ("junk", [_NEWS.encode().decode("latin-1"), _TALE.encode().decode("latin-1"), _LAW.encode().decode("cp1252", "replace")]),
    ("junk", [_NEWS.encode().decode("gbk", "replace"), _LAW.encode().decode("gbk", "replace"), _TALE.encode().decode("gb18030", "replace")]),
    ("junk", ["\n".join("%064x" % _rng.getrandbits(256) for _ in range(6)), "".join(_rng.choice("ABCDEFGHabcdefgh0123456789+/") for _ in range(400)), "%0400x" % _rng.getrandbits(1600)]),
    ("junk", [_lost(_NEWS, 0.3), _lost(_LAW * 2, 0.5), _lost(_TALE * 3, 0.4)]),
    ("junk", ["=-" * 90, "*~" * 60, "-+" * 200, "_" * 150]),
    ("junk", [_noise(300), _noise(180), _noise(420, "★■◆□~#@!%&*")]),
    ("junk", [_random_words(30), _random_words(45), _random_words(20)]),
    ("junk", ["哈" * 200, "顶" * 150, "赞" * 90 + "！" * 20]),
    ("junk", ["haha" * 60, "lol " * 70, "aaaaaaa" * 30]),
    ("junk", ["_".join(_NEWS), "~~".join(_TALE), "#".join(_LAW)]),
    ("junk", ["优惠促销 免费领取 " * 25, "best price buy now " * 25, "点击下载 " * 40]),
]
