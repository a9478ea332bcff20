"""Templates and rewrites of texts: prompts, masks, perturbations, clean-ups of known formats."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx
from .udfs import _each, split_sentences_value

# The labels of templates.
ALPACA = ("### Instruction:\n", "### Input:\n", "### Response:\n")
ALPACA_ZH = ("### 指令：\n", "### 输入：\n", "### 回答：\n")


def alpaca(instruction: Column, extra: Column, answer: Column, labels: tuple[str, str, str] = ALPACA) -> Column:
    """Instruction, input if there is one, and response under their labels."""
    a, b, c = map(F.lit, labels)
    middle = F.when(F.coalesce(F.trim(extra), F.lit("")) != "", F.concat(F.lit("\n\n"), b, extra)).otherwise("")
    return F.concat(a, instruction, middle, F.lit("\n\n"), c, answer)


def source_target(source: Column, target: Column, source_label: str = "", target_label: str = "简写：") -> Column:
    """(text, mask): source and target under their labels, 1 for the target's characters; null if a label stands in either."""
    s, t = tx.strip(source), tx.strip(target)
    labels = [x for x in (source_label, target_label) if x]
    bad = F.lit(False)
    for x in labels:
        bad = bad | F.contains(s, F.lit(x)) | F.contains(t, F.lit(x))
    prompt = F.concat(F.lit(source_label), s, F.lit(target_label))
    return F.when(~bad & (s != "") & (t != ""), F.struct(F.concat(prompt, t).alias("text"), F.concat(F.repeat(F.lit("0"), F.length(prompt)), F.repeat(F.lit("1"), F.length(t))).alias("mask")))


def reading_prompt(context: Column, question: Column) -> Column:
    """Fixed wording around a passage and a question on it."""
    return F.concat(F.lit("请根据给定材料回答问题，只依据材料，不补充材料外的信息。\n材料："), context, F.lit("\n问题："), question)


def lettered(question: Column, options: Column) -> Column:
    """A question with its options under letters."""
    return F.concat_ws("\n", question, F.array_join(F.transform(options, lambda o, i: F.concat(F.char(65 + i), F.lit(". "), o)), "\n"))


def perturbed(t: Column) -> Column:
    """(kind, text) of three variants: blanks between characters, no punctuation, a line break after each sentence."""
    spaced = F.array_join(F.filter(F.split(t, ""), lambda c: c != ""), " ")
    return F.array(
        F.struct(F.lit("spaced").alias("kind"), spaced.alias("text")),
        F.struct(F.lit("bare").alias("kind"), F.regexp_replace(t, r"\p{P}", "").alias("text")),
        F.struct(F.lit("broken").alias("kind"), F.regexp_replace(t, "([。！？!?；;])", "$1\n").alias("text")),
    )


def detokenized(t: Column, rounds: int = 3) -> Column:
    """Blanks of word segmentation off, around Han and before and after marks; the rounds reach a fixed point."""
    han, mark = r"\x{3400}-\x{9fff}", "，。！？、；：,.!?;:"
    out = F.regexp_replace(t, r"\s*·\s*", "·")
    pattern = f"(?<=[{han}]) +(?=[{han}A-Za-z0-9])|(?<=[A-Za-z0-9]) +(?=[{han}])| +(?=[{mark}）》】」』])|(?<=[{mark}]) +|(?<=[（《【「『]) +"
    for _ in range(rounds):
        out = F.regexp_replace(out, pattern, "")
    return out


def without_calculations(t: Column) -> Column:
    """Calculator notes such as <<3*4=12>> off."""
    return F.regexp_replace(t, r"<<[^<>]*>>", "")


def pattern_reason(t: Column, patterns: dict[str, str]) -> Column:
    """The name of the first pattern that matches; null for none and for null texts."""
    out = F.lit(None).cast("string")
    for name, p in reversed(patterns.items()):
        out = F.when(F.regexp_like(t, F.lit(p)), name).otherwise(out)
    return out


def ordinal_windows(t: Column, key: Column, width: int) -> Column:
    """A window of at most ``width`` characters at a place that the key's hash decides."""
    room = F.greatest(F.length(t) - width, F.lit(0)) + 1
    return F.substring(t, F.pmod(F.xxhash64(key), room).cast("int") + 1, F.lit(width))


def fragments(tokens: Column, width: int, overlap: int) -> Column:
    """Slices of ``width`` that overlap; the first of each but the first slice is context, not a target."""
    step = max(1, width - overlap)
    many = F.greatest(F.ceil((F.size(tokens) - overlap) / step), F.lit(1)).cast("int")
    return tx.let(tokens, lambda x: F.transform(F.sequence(F.lit(0), many - 1), lambda i: F.slice(x, i * step + 1, width)))


def plan_value(text: str, budget: int) -> list[str]:
    """Sentences packed under a budget of characters, never over an empty line; longer ones are cut."""
    out, own = [], ""
    for unit in split_sentences_value(text):
        while len(unit) > budget:
            if own:
                out.append(own)
                own = ""
            at = max(unit.rfind(c, 0, budget) for c in "，,、 ") + 1 or budget
            out.append(unit[:at])
            unit = unit[at:]
        if own and len(own) + len(unit) > budget:
            out.append(own)
            own = ""
        own += unit
        if re.search(r"\n[ \t]*\n", unit):
            out.append(own)
            own = ""
    return [*out, own] if own else out


plan_chunks = _each(plan_value, T.ArrayType(T.StringType()))
_NUMBERS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}


def obeys_value(prompt: str, answer: str) -> bool:
    """The answer keeps the prompt's plain demands: excluded words, lower case, numbers of sentences and bullets, ending."""
    amount = r"exactly (\d+|" + "|".join(_NUMBERS) + r") "
    count = lambda m: int(m[1]) if m[1].isdigit() else _NUMBERS[m[1].lower()]
    for clause in re.split(r"[.\n]", prompt):
        if re.search(r"\b(?:do not|don't|without|avoid|exclude)\b", clause, re.I):
            if any(re.search(rf"\b{re.escape(w)}\b", answer, re.I) for w in re.findall(r'["“]([^"“”]+)["”]', clause)):
                return False
    if re.search(r"all (?:in )?lowercase|entirely lowercase", prompt, re.I) and re.search("[A-Z]", answer):
        return False
    m = re.search(amount + "sentences?", prompt, re.I)
    if m and len(re.findall(r"[.!?](?=\s|$)", answer)) != count(m):
        return False
    m = re.search(amount + "bullet", prompt, re.I)
    if m and len(re.findall(r"(?m)^\s*[-*•]\s", answer)) != count(m):
        return False
    m = re.search(r'end(?:s|ing)? with (?:the (?:exact )?phrase )?["“]([^"“”]+)["”]', prompt, re.I)
    return not m or answer.rstrip().endswith(m[1])


obeys = _each(obeys_value, T.BooleanType())


def generation_prompt(instruction: Column, extra: Column, template: str = "chatml", system: str = "You are a helpful assistant.") -> Column:
    """What a model is asked with before it answers: chatml, alpaca, chinese_alpaca or legacy. Blanks around the texts go;
    an empty ``extra`` leaves its part out."""
    q, x = tx.strip(F.coalesce(instruction, F.lit(""))), tx.strip(F.coalesce(extra, F.lit("")))
    if template == "chatml":
        head = f"<|im_start|>system\n{system.strip()}<|im_end|>\n" if system.strip() else ""
        return F.concat(F.lit(head + "<|im_start|>user\n"), F.when(x == "", q).otherwise(F.concat(q, F.lit("\n\n"), x)), F.lit("<|im_end|>\n<|im_start|>assistant\n"))
    labels = {"alpaca": ("### Instruction:\n", "\n\n### Input:\n", "\n\n### Response:\n"), "chinese_alpaca": ("### 指令：\n", "\n\n### 输入：\n", "\n\n### 回答：\n"), "legacy": ("用户：", "\n输入：", "\n助手：")}
    if template not in labels:
        raise ValueError("template is chatml, alpaca, chinese_alpaca or legacy")
    a, b, c = map(F.lit, labels[template])
    return F.concat(a, q, F.when(x == "", "").otherwise(F.concat(b, x)), c)
