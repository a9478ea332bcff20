"""Problem 6: prompt and response pairs whose response is no proper answer, with the type of defect."""

from __future__ import annotations

import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .refusals import QUOTED, is_refusal

# Fillers that stand for no answer, in lower case without marks.
FILLERS = frozenset(
    "无 略 空 暂无 没有 無 暂缺 未填 待定 待补充 暂无内容 无内容 空白 无答案 无回答 没有答案 没有内容 内容略 不适用 此处略 同上 省略 none null nil nan na n a tbd todo empty blank undefined no answer "
    "noanswer nocontent notavailable notapplicable 없음 なし 該当なし".split()
)
# Frequent function words of languages in Latin letters.
WORDS = {
    "en": "the of and to a in is it was for on that with as at by be this from or are have not but they we you he she an if will which more can has under said because who most",
    "es": "el la los las de del y que en un una unas unos por para con se lo durante cuanto antes su al es son decidió piden como más",
    "fr": "le la les des du de et que en un une pour avec mais veut au aux plus est sont dans par sur servira décidé avant qui",
    "de": "der die das den dem des und zu in im ist sind mit auf für von bevor wird man seit ein eine hofft rund nutzen ihn werden nicht können",
    "it": "il lo gli di del della e che un una per con nel sono è alla dei",
    "pt": "o os as do da dos e que um uma para com no na são não em ao",
}
WORDS = {k: frozenset(v.split()) for k, v in WORDS.items()}
_CONTROL = re.compile(r"<\|[^|<>]*\|>|</?s>|\[/?(?:INST|PAD|EOS|BOS)\]|</?[a-z][^<>]{0,20}>", re.I)
_MARK = re.compile(r"[\W_]+")
#: A remark in brackets behind a closed sentence.
_ASIDE = re.compile(r"([。！？!?.．｡][”’」』\"'＂]*)\s*[（(【\[][^（）()【】\[\]]*[）)】\]]+\s*\Z")
_ENDS = "。！？!?.…．｡"
_CLOSE = "”’」』）)】》\"'＂]"

#: Complete answers that the model of breaks is fitted on; each also gives answers broken off at known places.
FIT_ROWS = 6000
#: Longer answers and sources aren't fitted on (they are judged like all others).
FIT_CHARS = 4000
DIMS = 1 << 18


def plain(text: str) -> str:
    """Letters and digits in lower case."""
    return _MARK.sub("", text.lower())


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by whole-row bit operations."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        u = row & at.get(c, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def shingles(text: str, k: int) -> set[str]:
    return {text[i : i + k] for i in range(len(text) - k + 1)}


def is_empty(target: str | None) -> bool:
    if target is None:
        return True
    left = plain(_CONTROL.sub("", target))
    return not left or left in FILLERS


def is_copied(source: str, target: str) -> bool:
    """Nearly all shingles of the source stand in the target, and its letters do in order."""
    a, b = plain(source), plain(target)
    if not a or len(b) < len(a) - max(2, len(a) // 50):
        return False
    if a in b:
        return True
    k = 5 if len(a) >= 40 else 2
    of = shingles(a, k)
    if not of or len(of & shingles(b, k)) < (0.85 if len(a) >= 40 else 0.7) * len(of):
        return False
    return lcs(a, b) >= len(a) - max(2, len(a) // 50)


# Where the blocks of scripts begin and end.
_BLOCKS = {
    "greek": [(0x370, 0x400)], "cyrillic": [(0x400, 0x530)], "hebrew": [(0x590, 0x600)], "arabic": [(0x600, 0x700)], "devanagari": [(0x900, 0x980)], "thai": [(0xE00, 0xE80)],
    "hangul": [(0x1100, 0x1200), (0xAC00, 0xD7A4)], "kana": [(0x3041, 0x3100)], "han": [(0x3400, 0x4DC0), (0x4E00, 0xA000), (0x20000, 0x110000)],
}
_STEPS = np.array(sorted({x for own in _BLOCKS.values() for pair in own for x in pair}), np.uint32)
_SCRIPTS = {int(np.searchsorted(_STEPS, a, "right")): script for script, own in _BLOCKS.items() for a, _ in own}


def language(text: str) -> str | None:
    """The language most of a text is written in; None if too little of it is words."""
    text = _CONTROL.sub(" ", text)
    text = QUOTED.sub(" ", text) if len(_MARK.sub("", QUOTED.sub(" ", text))) >= 6 else text
    n = dict.fromkeys(_SCRIPTS.values(), 0)
    if not text.isascii():
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        many = np.bincount(np.searchsorted(_STEPS, cp, "right"), minlength=len(_STEPS) + 1)
        for i, script in _SCRIPTS.items():
            n[script] += int(many[i])
    latin = [w for w in re.findall(r"[a-zà-öø-ÿāăąćčďđēęěğīıłńňőœřśşšťūůűźżž]+(?:'[a-z]+)?", re.sub(r"\S*\d\S*|https?:\S+", " ", text.lower())) if len(w) > 1 or w in "aày"]
    words = {"zh": n["han"] / 1.6, "ja": 0.0, "ko": n["hangul"] / 2.5, "ru": n["cyrillic"] / 5, "ar": n["arabic"] / 4, "th": n["thai"] / 4, "el": n["greek"] / 5, "hi": n["devanagari"] / 4, "he": n["hebrew"] / 4, "latin": float(len(latin))}
    if n["kana"] > 0.15 * (n["han"] + n["kana"]):
        words["ja"], words["zh"] = (n["han"] + n["kana"]) / 2, 0.0
    best = max(words, key=words.get)
    if words[best] < 2:
        return None
    if best != "latin":
        return best
    votes = {k: sum(w in v for w in latin) for k, v in WORDS.items()}
    lead = max(votes, key=votes.get)
    return lead if votes[lead] else "latin"


def is_other_language(source: str, target: str) -> bool:
    a, b = language(source), language(target)
    return a is not None and b is not None and a != b and not (a == "latin" and b in WORDS) and not (b == "latin" and a in WORDS)


# --- broken off inside the last sentence ---------------------------------------------------------


def bare_end(text: str) -> str:
    """The text without closing marks, stray marks and blanks at its end."""
    i = len(text)
    while i and not text[i - 1].isalnum() and text[i - 1] != "%":
        i -= 1
    return text[:i]


def closed(text: str) -> bool:
    """Ends with a sentence mark, quotes and brackets after it aside."""
    t = _CONTROL.sub("", text).rstrip()
    while (bare := _ASIDE.sub(r"\1", t)) != t:
        t = bare
    while t and (t[-1] in _CLOSE or t[-1].isspace() or unicodedata.category(t[-1])[0] == "C"):
        t = t[:-1]
    return bool(t) and t[-1] in _ENDS and not t.endswith(("……", "...", "…"))


def last_sentence(text: str) -> str:
    """What follows the last sentence mark; a full stop counts where a blank follows."""
    cut = 0
    for m in re.finditer(r"[。！？!?；;\n]|\.(?=\s)", text):
        if m.end() < len(text):
            cut = m.end()
    return text[cut:]


def _mask(s: str) -> str:
    return re.sub(r"[A-Za-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "0", s))) if not re.search(r"[a-z]{3} [a-z]", s) else re.sub(r"\d", "0", s)


def break_features(source: str | None, text: str) -> np.ndarray:
    """Hashed features of how a text without its closing mark ends, and of what the source has there."""
    sent = last_sentence(text).strip()
    masked = _mask(sent)
    f = [f"n{min(len(sent) // 4, 12)}"]
    ends = [masked[-k:] for k in (1, 2, 3, 4, 6)]
    f += [f"e{e}" for e in ends]
    body = masked[:-2]
    grams = {body[i : i + 2] for i in range(len(body) - 1)} if not re.search(r"[a-z] [a-z]", sent) else set(body.split()[:-1])
    f += [f"g{g}" for g in grams]
    last = ends[1] if len(masked) > 1 and "一" <= masked[-1] <= "鿿" else masked.split()[-1] if masked.split() else ""
    f += [f"c{g}|{last}" for g in grams]
    f += [f"w{g}|{masked[-1:]}" for g in grams]
    digits = re.search(r"[0A-Za.\-%]*\Z", masked)[0]
    f.append(f"d{digits}")
    f.append(f"l{masked.count('、')}|{masked.count('，') + masked.count(',')}")
    if source:
        for k in (8, 6, 4, 3):
            tail = sent[-k:]
            at = source.rfind(tail) if len(tail) == k else -1
            if at >= 0:
                nxt = source[at + k : at + k + 2]
                f.append(f"s{k}|{_mask(nxt)}")
                f.append(f"t{ends[1]}|{_mask(nxt[:1])}")
                if sent[-1:].isascii() and sent[-1:].isalnum() and re.match(r"[A-Za-z0-9]|[-.、,][A-Za-z0-9]", nxt):
                    f.append("inside a token")
                # words the source's sentence still has, not yet said
                rest = re.split(r"[。！？!?；;\n]|\.\s", source[at + k :])[0][:40]
                f += [f"r{rest[i : i + 2]}|{rest[i : i + 2] in sent}" for i in range(0, max(0, len(rest) - 1))]
                break
        else:
            f.append("not in source")
    return np.fromiter({zlib.crc32(x.encode()) % DIMS for x in f}, np.int64)


def fit_breaks(rows: list[tuple[str | None, str]], seed: int = 7) -> np.ndarray:
    """Weights (the last is the bias) that tell answers broken off from whole ones without closing mark.

    The labels come from the answers themselves: as they are, without their closing marks, they are whole;
    cut at a random place of the last sentence they are broken.
    """
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for i, (source, target) in enumerate(rows):
        source = source if i % 6 else None  # some answers come without their source
        whole = bare_end(target)
        tail = len(last_sentence(whole).strip())
        if tail < 6:
            continue
        xs.append(break_features(source, whole))
        ys.append(0.0)
        for back in rng.integers(1, max(2, tail - 2), 2):
            broken = bare_end(whole[: len(whole) - int(back)])
            if broken and len(whole) - len(broken) < tail - 1:
                xs.append(break_features(source, broken))
                ys.append(1.0)
    w, g2, b = np.zeros(DIMS), np.full(DIMS, 1e-6), 0.0
    y = np.array(ys)
    for _ in range(6):
        for i in rng.permutation(len(xs)):
            x = xs[i]
            p = 1 / (1 + np.exp(-np.clip(w[x].sum() + b, -30, 30)))
            d = p - y[i]
            g2[x] += d * d
            w[x] -= 0.25 * d / np.sqrt(g2[x])
            b -= 0.01 * d
    return np.append(w, b).astype(np.float32)


#: The score from which an answer without a closing mark breaks off.
OPEN_SCORE = 0.0


def _score(weights: np.ndarray, source: str | None, text: str) -> float:
    return float(weights[break_features(source, text)].sum() + weights[-1])


def _in_source(source: str | None, text: str) -> str | None:
    """``inside`` or ``end``: where in the source the text's last words stand; None if that decides nothing."""
    tail = last_sentence(text).strip()[-8:]
    at = source.rfind(tail) if source and len(tail) >= 6 else -1
    if at < 0:
        return None
    rest = source[at + len(tail) :]
    if text[-1].isascii() and text[-1].isalnum() and re.match(r"[A-Za-z0-9]|[-.][A-Za-z0-9]", rest) or re.match(r"、\w", rest) and "、" in tail:
        return "inside"
    return "end" if re.match(r"\s*(?:[。！？!?；;．]|\.(?:\s|\Z)|\Z)", rest) else None


def is_broken(weights: np.ndarray, source: str | None, target: str) -> bool:
    """Breaks off inside its last sentence; one with a closing mark doesn't."""
    text = _CONTROL.sub("", target).rstrip()
    end = bare_end(text)
    if not end or closed(text):
        return False
    where = _in_source(source, end)
    return where == "inside" or where is None and _score(weights, source, end) > OPEN_SCORE


def text_defect(source: str | None, target: str | None, weights: np.ndarray) -> str | None:
    """The first defect that the texts alone show."""
    if is_empty(target):
        return "empty"
    if is_refusal(source, target):
        return "refusal"
    if source is not None and plain(source):
        if is_copied(source, target):
            return "copied"
        if is_other_language(source, target):
            return "other_language"
    return "truncated" if is_broken(weights, source, target) else None


def flag_pairs(pairs: DataFrame, decisions: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(pair_id, defect): every defective pair once, with the first defect of empty, refusal, copied,
    other_language and truncated that fits.

    A null target is empty; a null or wordless source rules out only copied and other_language. A pair
    delivered under several ids is judged under each; a pair_id that occurs twice gets the first defect of
    its rows in that order. truncated also comes from the newest decision (by decided_at, then decision_id;
    null times are oldest), where its flag is true. Decisions without a pair have no effect.

    Whether an unclosed answer breaks off is judged by a linear model, fitted on at most ``fit_rows`` whole
    answers (those with the least hashes of pair_id). The texts aren't shuffled, only ids and defects are.
    """
    spark = pairs.sparkSession
    whole = pairs.select("pair_id", "source", "target").filter(F.regexp_like("target", F.lit(r"[。.！？!?]\s*\z")) & F.length("target").between(20, FIT_CHARS) & (F.length("source") <= FIT_CHARS))
    some = whole.orderBy(F.xxhash64("pair_id"), "pair_id").limit(fit_rows).select("source", "target").collect()
    weights = spark.sparkContext.broadcast(fit_breaks([(r[0], r[1]) for r in some]))

    def run(batches):
        w = weights.value
        for batch in batches:
            found = [text_defect(s, t, w) for s, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["pair_id", "defect"])

    kind = pairs.schema["pair_id"].dataType.simpleString()
    by_text = pairs.select("pair_id", "source", "target").mapInArrow(run, f"pair_id {kind}, defect string")
    newest = decisions.groupBy("pair_id").agg(F.max_by("truncated", F.struct("decided_at", "decision_id")).alias("cut")).filter("cut")
    order = F.array(*map(F.lit, ("empty", "refusal", "copied", "other_language", "truncated")))
    both = by_text.join(newest, "pair_id", "left").select("pair_id", F.coalesce("defect", F.when(F.col("cut"), "truncated")).alias("defect")).filter("defect is not null")
    return both.groupBy("pair_id").agg(F.min(F.array_position(order, F.col("defect"))).alias("n")).select("pair_id", F.element_at(order, F.col("n").cast("int")).alias("defect"))
