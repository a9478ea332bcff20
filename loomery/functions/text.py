"""Text functions as column expressions: normalisers, ratios, n-grams, numbers. None of them needs Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters and patterns the results depend on.
ZERO_WIDTH = r"[\x{feff}\x{200b}-\x{200f}\x{2060}]"
CONTROL_OR_BLANK = r"[ \t\x{a0}\x{3000}\x00-\x08\x0b-\x1f\x7f-\x{9f}\p{Cf}\p{Co}\p{Cs}]+"
HAN = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]"
URL = r"(?i)https?://\S+|www\.\S+"
HTML_TAG = r"<[^>\n]{1,120}>"
NUMBER_METRIC = r"\p{Nd}+(?:\.\p{Nd}+)?%?"
NUMBER_SPAN = r"\p{Nd}+(?:[.:：/\-—]\p{Nd}+)*%?"
#: Digits of any kind: decimal digits, and superscript, circled and other digits without a decimal value.
DIGIT = (
    r"[\p{Nd}\x{b2}-\x{b3}\x{b9}\x{1369}-\x{1371}\x{19da}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247c}\x{2488}-\x{2490}\x{24ea}\x{24f5}-\x{24fd}\x{24ff}"
    r"\x{2776}-\x{277e}\x{2780}-\x{2788}\x{278a}-\x{2792}\x{10a40}-\x{10a43}\x{10e60}-\x{10e68}\x{11052}-\x{1105a}\x{1f100}-\x{1f10a}]"
)
SENTENCE_ENDINGS = "。！？.!?；;）)]】》\"'”’"
CLOSING = "。！？.!?"
BLANK = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]"
#: The same characters one by one, for trimming.
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f uses it (also inside higher-order functions)."""
    return F.element_at(F.transform(F.array(value), f), 1)


def strip(c: Column | str) -> Column:
    """Unicode blanks off both ends."""
    return F.btrim(col(c), F.lit(BLANKS))


def clean_text(c: Column | str) -> Column:
    """Zero-width characters off, one kind of line break, control characters to blanks, lines stripped, empty ones off.

    Null stays null. Compatibility forms aren't folded here: ``udfs.nfkc`` does that where a policy asks.
    """
    t = F.regexp_replace(col(c), ZERO_WIDTH, "")
    t = F.regexp_replace(t, r"\r\n?", "\n")
    t = F.regexp_replace(t, CONTROL_OR_BLANK, " ")
    return strip(F.regexp_replace(t, r"[\s\p{Z}]*\n[\s\p{Z}]*", "\n"))


def dedupe_form(c: Column | str) -> Column:
    """Letters and digits in lower case: equal forms are duplicates in normalized mode."""
    return F.lower(F.regexp_replace(col(c), r"[^\p{L}\p{N}]+", ""))


def dedupe_digest(c: Column | str, mode: Column | str) -> Column:
    """Digest by mode (``normalized``, ``exact``); null for ``none``, so that nothing is a duplicate."""
    mode = F.lit(mode) if isinstance(mode, str) else mode
    return F.when(mode == "normalized", F.sha2(dedupe_form(c), 256)).when(mode == "exact", F.sha2(col(c), 256))


def chat_text(c: Column | str) -> Column:
    """For messages: line breaks, NUL off, blanks within lines to one, none between Han, at most one empty line."""
    t = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\r\n?", "\n")
    t = F.regexp_replace(t, r"\x00", "")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r"(?m)^[ \x{a0}\x{3000}]+|[ \x{a0}\x{3000}]+$", "")
    t = F.regexp_replace(t, r"(?<=[\x{3400}-\x{9fff}]) +(?=[\x{3400}-\x{9fff}])", "")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def compact(c: Column | str) -> Column:
    """No blanks at all."""
    return F.regexp_replace(col(c), f"{BLANK}+", "")


def surface(c: Column | str) -> Column:
    """Word characters and Han in lower case; the underscore stays."""
    return F.lower(F.regexp_replace(compact(c), r"[^\p{L}\p{N}_\x{3400}-\x{9fff}]+", ""))


def answer_form(c: Column | str) -> Column:
    """No blanks, no closing marks at the end."""
    return F.regexp_replace(compact(c), f"[{CLOSING}]+\\z", "")


def safe_tags(c: Column | str) -> Column:
    """Reserved chat labels made harmless by full-width brackets."""
    return F.regexp_replace(col(c), r"<(\|im_(?:start|end)\|)>", "＜$1＞")


def ratio(a: Column, b: Column, none: float = 0.0) -> Column:
    """a / b, or ``none`` where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(none))


def matched_chars(c: Column | str, pattern: str) -> Column:
    """Characters inside matches of a pattern."""
    return F.length(col(c)) - F.length(F.regexp_replace(col(c), pattern, ""))


def visible_chars(c: Column | str) -> Column:
    return F.length(compact(c))


def cjk_ratio(c: Column | str, visible: Column | None = None) -> Column:
    """Han among the visible characters; 0 for blank texts."""
    return ratio(matched_chars(c, HAN), visible_chars(c) if visible is None else visible)


def url_ratio(c: Column | str) -> Column:
    return ratio(matched_chars(c, URL), F.greatest(F.length(col(c)), F.lit(1)))


def html_ratio(c: Column | str) -> Column:
    return ratio(matched_chars(c, HTML_TAG), F.greatest(F.length(col(c)), F.lit(1)))


def punctuation_ratio(c: Column | str, visible: Column | None = None) -> Column:
    return ratio(matched_chars(c, r"\p{P}"), visible_chars(c) if visible is None else visible)


def digit_ratio(c: Column | str, visible: Column | None = None) -> Column:
    return ratio(matched_chars(c, DIGIT), visible_chars(c) if visible is None else visible)


def lines(c: Column | str) -> Column:
    """The lines that aren't blank, stripped."""
    return F.filter(F.transform(F.split(col(c), r"[\n\x{2028}\x{2029}]"), strip), lambda x: x != "")


def repeated_line_ratio(c: Column | str) -> Column:
    """Lines that repeat an earlier one among all lines; 0 under four lines."""
    return let(lines(c), lambda own: F.when(F.size(own) >= 4, ratio(F.size(own) - F.size(F.array_distinct(own)), F.size(own))).otherwise(F.lit(0.0)))


def char_ngrams(c: Column | str, n: int, whole_if_short: bool = False) -> Column:
    """All n-grams of characters; of a shorter text none, or itself if ``whole_if_short`` (the empty text has none)."""

    def of(cs: Column) -> Column:  # characters one by one, so that a gram is found without counting from the text's start
        grams = F.transform(F.sequence(F.lit(0), F.greatest(F.size(cs) - n, F.lit(0))), lambda i: F.concat(*(F.get(cs, i + j) for j in range(n))))
        none = F.array().cast("array<string>")
        short = F.when(F.size(cs) > 0, F.array(F.array_join(cs, ""))).otherwise(none) if whole_if_short else none
        return F.when(F.size(cs) >= n, grams).otherwise(F.when(cs.isNotNull(), short))

    return let(F.filter(F.split(col(c), ""), lambda x: x != ""), of)


def repetition_ratio(c: Column | str, n: int = 4) -> Column:
    """Repeated n-grams of the compact text among all; 0 where it has none."""
    return let(char_ngrams(compact(c), n), lambda g: ratio(F.size(g) - F.size(F.array_distinct(g)), F.size(g)))


def numbers(c: Column | str, pattern: str = NUMBER_METRIC) -> Column:
    return F.regexp_extract_all(col(c), F.lit(pattern), F.lit(0))


def _times(xs: Column, x: Column) -> Column:
    return F.size(F.filter(xs, lambda y: y == x))


def multiset_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    return let(F.struct(a.alias("a"), b.alias("b")), lambda x: F.aggregate(F.array_distinct(x["a"]), F.lit(0), lambda acc, y: acc + F.least(_times(x["a"], y), _times(x["b"], y))))


def numbers_kept(a: Column, b: Column) -> Column:
    """Every element of a stands in b at least as often."""
    return let(F.struct(a.alias("a"), b.alias("b")), lambda x: F.forall(F.array_distinct(x["a"]), lambda y: _times(x["b"], y) >= _times(x["a"], y)))


def same_multiset(a: Column, b: Column) -> Column:
    return F.array_sort(a) == F.array_sort(b)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if both are empty."""
    return let(F.struct(a.alias("a"), b.alias("b")), lambda x: ratio(F.size(F.array_intersect(x["a"], x["b"])), F.size(F.array_union(x["a"], x["b"]))))


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def unchanged_end(source: Column | str, candidate: Column | str, least: int = 40) -> Column:
    """A source of some length ends a sentence, the candidate doesn't."""
    s, t = F.rtrim(col(source)), F.rtrim(col(candidate))
    ends = lambda x: F.instr(F.lit(SENTENCE_ENDINGS), F.right(x, F.lit(1))) > 0
    return (F.length(s) >= least) & ends(s) & ((F.length(t) == 0) | ~ends(t))


def hash_fraction(key: Column, seed: int | None = None) -> Column:
    """The first 16 hex digits of a sha256; as text they order like the number they stand for."""
    return F.substring(F.sha2(F.concat(F.lit(f"{seed}\0"), key) if seed is not None else key, 256), 1, 16)


def hash_mod(key: Column, m: int) -> Column:
    """The first 64 bits of the sha256 as an unsigned number, modulo m."""
    return (F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)") % m).cast("int")


def bytes_text(n: Column) -> Column:
    """A number of bytes in the largest unit up to TB in which it is at least 1; negative numbers count as 0."""
    v = F.greatest(n.cast("bigint"), F.lit(0))
    out = F.format_string("%.2f TB", v / float(1 << 40))
    for k, unit in ((30, "GB"), (20, "MB"), (10, "KB")):
        out = F.when(v < float(1 << (k + 10)), F.format_string(f"%.2f {unit}", v / float(1 << k))).otherwise(out)
    return F.when(n.isNotNull(), F.when(v < 1024, F.format_string("%d B", v)).otherwise(out))


def duration_text(seconds: Column) -> Column:
    """Whole seconds as hours, minutes and seconds; negative ones count as 0."""
    s = F.greatest(seconds.cast("bigint"), F.lit(0))
    return F.when(seconds.isNotNull(), F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60))


def softmax(scores: Column) -> Column:
    """Of an array of scores the probabilities; empty for an empty one."""
    return let(scores, lambda x: let(F.transform(x, lambda y: F.exp(y - F.array_max(x))), lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, y: a + y), lambda total: F.transform(e, lambda y: y / total))))
