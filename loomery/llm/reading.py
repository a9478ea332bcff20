"""Problem 9: the reading level of each document, by a pairwise ranker calibrated into levels."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import LETTER, blocks, classes, codepoints

DIMS = 1 << 15
SYNTAX = 8
#: At most so many labelled documents are fitted on: those with the least hashes of doc_id.
FIT_DOCS = 4000
#: Longer documents aren't fitted on (they get a level like all others).
FIT_CHARS = 20_000
BINS = 2000

_MARKUP = re.compile(r"<\|[^|<>]{0,40}\|>(?:\s*(?:system|user|assistant)\b)?|</?[A-Za-z][^<>]{0,200}>|https?://[^\s，。；、）)]+|&[a-z]{2,6};|\[/?INST\]|</?s>")
_ENDS = tuple(map(ord, "。！？!?；;\n．｡"))


def clean(text: str | None) -> str:
    """Lower case, without markup, chat labels and URLs; the text as it is if nothing else holds letters."""
    if not text:
        return ""
    bare = _MARKUP.sub(" ", text)
    return (bare if any(map(str.isalpha, bare)) else text).lower()


def sentences(texts: list[str]):
    """Code points, text number and first character of every sentence, and for each character its sentence."""
    cp, at = codepoints(texts)
    n = len(cp)
    if not n:
        return cp, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    end = np.isin(cp, _ENDS)
    dot = np.flatnonzero(cp == 0x2E)
    dot = dot[dot + 1 < n]
    end[dot[np.isin(cp[dot + 1], (0x20, 0x0A))]] = True
    start = np.zeros(n, bool)
    start[1:] = end[:-1]
    start[at[:-1][np.diff(at) > 0]] = True
    first = np.flatnonzero(start)
    return cp, np.searchsorted(at, first, "right") - 1, first, np.cumsum(start) - 1


def features(cp: np.ndarray, first: np.ndarray, of: np.ndarray):
    """Of each sentence: hashed 2- and 3-grams with their sentence, its letters, and measures of its syntax."""
    n, k = len(cp), len(first)
    c = cp.astype(np.uint64)
    han = (cp >= 0x3400) & (cp <= 0x9FFF) | (cp >= 0x20000)
    digit = (cp >= 0x30) & (cp <= 0x39)
    small = (cp >= 0x61) & (cp <= 0x7A) | (cp >= 0xC0) & (cp < 0x2000)
    letter = classes()[cp] == LETTER
    c[digit] = 0x30
    with np.errstate(over="ignore"):
        two = (c[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
        three = (two[:-1] + c[2:]) * np.uint64(0x165667B19E3779F9) if n > 2 else two[:0]
    shift = np.uint64(64 - 15)
    ok2 = (of[:-1] == of[1:]) & (letter[:-1] | letter[1:])
    ok3 = ok2[:-1] & ok2[1:] if n > 2 else ok2[:0]
    index = np.concatenate([(two[ok2] >> shift), (three[ok3] >> shift)]).astype(np.int64)
    sent = np.concatenate([of[:-1][ok2], of[: len(ok3)][ok3]])
    per = lambda m: np.bincount(of[m], minlength=k).astype(np.float64)
    size = per(letter)
    some = np.maximum(size, 1)
    comma = np.isin(cp, tuple(map(ord, "，,、：:")))
    quote = np.isin(cp, tuple(map(ord, "“”\"「」")))
    latin_words = per((cp == 0x20)) + 1
    syntax = np.stack([
        np.log1p(size), per(comma) / some * 10, per(quote) / some * 10, per(digit) / some * 5, per(han) / some,
        np.minimum(per(small) / latin_words, 15) / 5, np.log1p(size / (per(comma) + 1)), np.ones(k),
    ], 1)
    return index, sent, size, syntax


def document_vector(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A document as the letter-weighted mean of its sentences: places and values; syntax after the n-grams."""
    cp, _, first, of = sentences([text])
    if not len(cp):
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    index, _, size, syntax = features(cp, first, of)
    hot, many = np.unique(index, return_counts=True)
    mean = (syntax * size[:, None]).sum(0) / max(1, size.sum())
    return np.concatenate([hot, DIMS + np.arange(SYNTAX)]).astype(np.int32), np.concatenate([many / max(1, len(index)) * 4, mean * 0.1]).astype(np.float32)


def fit_ranker(docs: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, epochs: int = 14, seed: int = 5) -> np.ndarray:
    """Weights that put of two documents the one graded higher above the other (logistic loss on pairs)."""
    rng = np.random.default_rng(seed)
    w, g2 = np.zeros(DIMS + SYNTAX), np.full(DIMS + SYNTAX, 1e-5)
    idx = np.arange(len(docs))
    for _ in range(epochs):
        left, right = rng.permutation(idx), rng.permutation(idx)
        for a, b in zip(left, right):
            if grades[a] == grades[b]:
                continue
            if grades[a] < grades[b]:
                a, b = b, a
            (ia, va), (ib, vb) = docs[a], docs[b]
            margin = w[ia] @ va - w[ib] @ vb
            g = min(1.0, grades[a] - grades[b]) / (1 + np.exp(min(30.0, max(-30.0, margin))))
            if g > 1e-3:
                for i, v in ((ia, va * g), (ib, -vb * g)):
                    g2[i] += v * v
                    w[i] += 0.2 * v / np.sqrt(g2[i])
    return w


def isotonic(score: np.ndarray, value: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the first score of each step and the rising values."""
    order = np.argsort(score, kind="stable")
    steps: list[list[float]] = []
    for i in order:
        steps.append([score[i], value[i], weight[i]])
        while len(steps) > 1 and steps[-2][1] >= steps[-1][1]:
            s, v, m = steps.pop()
            p = steps[-1]
            p[1], p[2] = (p[1] * p[2] + v * m) / (p[2] + m), p[2] + m
    return np.array([s[0] for s in steps]), np.array([s[1] for s in steps])


def sentence_scores(w: np.ndarray, texts: list[str]):
    """Text number, score and letters of every sentence that has letters."""
    cp, text, first, of = sentences(texts)
    if not len(cp):
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    index, sent, size, syntax = features(cp, first, of)
    k = len(first)
    many = np.maximum(np.bincount(sent, minlength=k), 1)
    score = np.bincount(sent, weights=w[index], minlength=k) / many * 4 + syntax @ w[DIMS:] * 0.1
    ok = size > 0
    return text[ok], score[ok], size[ok]


def label_grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): the mean of the raters' grades; a rater's newest row counts once, null grades don't."""
    own = labels.filter("grade between 1 and 3 and doc_id is not null").groupBy("doc_id", "rater").agg(F.max_by("grade", F.struct("rated_at", "grade")).alias("grade"))
    return own.groupBy("doc_id").agg(F.avg("grade").alias("grade"))


def reading_levels(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """(doc_id, grade, score): the level (1 to 3) of most of each document's text, and its mean score.

    Documents without a letter have no row; ids that repeat have a row each. Without labels every grade is 2.

    A linear ranker over vocabulary (hashed n-grams) and syntax is fitted on pairs of at most ``fit_docs``
    labelled documents. Isotonic regression of the grades on the scores of their sentences gives the levels;
    a document has the level that most of its letters stand in, ties going to the lower one.
    """
    spark = docs.sparkSession
    sample = label_grades(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs)
    ids = spark.createDataFrame(sample.collect(), "doc_id bigint, _grade double")  # at most fit_docs rows
    graded = docs.select("doc_id", "text").filter(F.length("text") <= FIT_CHARS).join(F.broadcast(ids), "doc_id")

    def vectors(batches):
        for b in batches:
            got = [document_vector(clean(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.list_(pa.float32()))], names=["grade", "i", "v"])

    rows = graded.select("doc_id", "text", "_grade").mapInArrow(vectors, "grade double, i array<int>, v array<float>").toArrow()
    vec = [(i.values.to_numpy(), v.values.to_numpy().astype(np.float64)) for i, v in zip(rows["i"], rows["v"])]
    grade = rows["grade"].to_numpy()
    keep = [n for n, (i, _) in enumerate(vec) if len(i)]
    w = fit_ranker([vec[n] for n in keep], grade[keep])
    spread = max(1e-6, float(np.abs([w[vec[n][0]] @ vec[n][1] for n in keep]).max())) * 1.5 if keep else 1.0
    shared = spark.sparkContext.broadcast(w)

    def binned(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            g = b.column(2).to_numpy()
            for x, y in blocks(texts):
                text, score, size = sentence_scores(shared.value, [clean(t) for t in texts[x:y]])
                at = np.clip((score / spread + 1) / 2 * BINS, 0, BINS - 1).astype(np.int64)
                n = np.bincount(at, weights=size, minlength=BINS)
                s = np.bincount(at, weights=size * g[x:y][text], minlength=BINS)
                hot = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(hot), pa.array(n[hot]), pa.array(s[hot])], names=["bin", "n", "s"])

    found = graded.select("doc_id", "text", "_grade").mapInArrow(binned, "bin bigint, n double, s double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).toPandas().sort_values("bin")
    centre = (found["bin"].to_numpy() / BINS * 2 - 1) * spread
    step, value = isotonic(centre, (found["s"] / found["n"]).to_numpy(), found["n"].to_numpy()) if len(found) else (np.array([-np.inf]), np.array([2.0]))
    first = [float(step[np.argmax(value >= x)]) if (value >= x).any() else np.inf for x in (1.5, 2.5)]

    def levels(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            for x, y in blocks(texts):
                text, score, size = sentence_scores(shared.value, [clean(t) for t in texts[x:y]])
                n = y - x
                level = np.searchsorted(first, score, "right")
                mass = np.bincount(text * 3 + level, weights=size, minlength=3 * n).reshape(n, 3)
                mean = np.bincount(text, weights=score * size, minlength=n) / np.maximum(1, mass.sum(1))
                ok = mass.sum(1) > 0
                yield pa.RecordBatch.from_arrays([b.column(0).slice(x, n).filter(pa.array(ok)), pa.array((mass.argmax(1) + 1)[ok].astype(np.int32)), pa.array(mean[ok])], names=["doc_id", "grade", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").filter(F.regexp_like("text", F.lit(r"\p{L}"))).mapInArrow(levels, f"doc_id {kind}, grade int, score double")
