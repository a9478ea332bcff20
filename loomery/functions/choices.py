"""Questions with options from public test sets in one form: (context, options, answer_index)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx


def choice(context: Column, options: Column, answer: Column) -> Column:
    return F.struct(context.alias("context"), options.alias("options"), answer.cast("int").alias("answer_index"))


def without_notes(c: Column | str) -> Column:
    """Bracketed notes off, blanks to one."""
    t = F.replace(F.coalesce(tx.col(c), F.lit("")), F.lit("[title]"), F.lit(" "))
    return tx.strip(F.regexp_replace(F.regexp_replace(t, r"\[[^\]]*\]", " "), r"[\s\p{Z}]+", " "))


def endings(ctx: Column, options: Column, label: Column) -> Column:
    """A beginning and its possible endings; null where the label is no number."""
    own = F.transform(options, lambda o: F.concat(F.lit(" "), without_notes(o)))
    return F.when(F.regexp_like(tx.strip(label), F.lit(r"^\p{Nd}+$")), choice(without_notes(ctx), own, tx.strip(label)))


def labelled(question: Column, texts: Column, labels: Column, key: Column) -> Column:
    """A question whose options have labels of their own; a key that no option has is an error."""
    at = F.array_position(F.transform(labels, tx.strip), tx.strip(key)).cast("int")
    checked = F.when(at > 0, at - 1).otherwise(F.raise_error(F.concat(F.lit("no option has the label "), key)).cast("int"))
    return choice(F.concat(F.lit("Question: "), tx.strip(question), F.lit("\nAnswer:")), F.transform(texts, lambda t: F.concat(F.lit(" "), tx.strip(t))), checked)


def yes_no(passage: Column, question: Column, answer: Column) -> Column:
    asked = F.concat(F.rtrim(tx.strip(question), F.lit("?")), F.lit("?"))
    return choice(F.concat(tx.strip(passage), F.lit("\nQuestion: "), asked, F.lit("\nAnswer:")), F.array(F.lit(" no"), F.lit(" yes")), F.coalesce(answer, F.lit(False)).cast("int"))


def gap(sentence: Column, option1: Column, option2: Column, answer: Column) -> Column:
    """A sentence with one gap: what stands before it, and each filling with the rest; null with no or several gaps."""
    parts = F.split(sentence, "_", -1)
    return F.when(F.size(parts) == 2, choice(parts[0], F.array(F.concat(option1, parts[1]), F.concat(option2, parts[1])), tx.strip(answer).cast("int") - 1))


def exam_text(question: Column, options: Column, label: str) -> Column:
    lines = F.array_join(F.transform(options, lambda o, i: F.concat(F.char(65 + i), F.lit(". "), tx.strip(o))), "\n")
    return F.concat(tx.strip(question), F.lit("\n"), lines, F.lit("\n" + label))


def exam(subject: Column, question: Column, options: Column, answer: Column) -> Column:
    """An exam question of a subject with the number of its answer; the options are letters."""
    head = F.concat(F.lit("The following are multiple choice questions (with answers) about "), F.replace(subject, F.lit("_"), F.lit(" ")), F.lit(".\n\n"))
    letters = F.transform(options, lambda o, i: F.concat(F.lit(" "), F.char(65 + i)))
    return choice(F.concat(head, exam_text(question, options, "Answer:")), letters, answer)


def exam_zh(question: Column, options: Column, answer: Column) -> Column:
    """The same in Chinese with the letter of its answer; null where that is none of A to D."""
    letter = F.upper(tx.strip(answer))
    head = F.lit("以下是中国考试的单项选择题，请选出其中的正确答案。\n\n")
    own = choice(F.concat(head, exam_text(question, options, "答案：")), F.array(*map(F.lit, "ABCD")), F.instr(F.lit("ABCD"), letter) - 1)
    return F.when(letter.isin("A", "B", "C", "D"), own)


def layout(texts: Column, kind: Column | str) -> Column:
    """Sentences put together: continuous, one a line, paragraphs of four, or lines of three; null for another layout."""
    k = F.lit(kind) if isinstance(kind, str) else kind

    def by(xs: Column, n: int, sep: str) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(xs) / n).cast("int") - 1, F.lit(0)))
        return F.array_join(F.transform(places, lambda i: F.array_join(F.slice(xs, i * n + 1, n), "")), sep)

    return tx.let(texts, lambda xs: F.when(k == "continuous", F.array_join(xs, "")).when(k == "line_per_sentence", F.array_join(xs, "\n")).when(k == "paragraphs", by(xs, 4, "\n\n")).when(k == "mixed", by(xs, 3, "\n")))
