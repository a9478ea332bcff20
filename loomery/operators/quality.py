"""Cleaning policies and the first reason to reject a text, as a column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


@dataclass(frozen=True)
class Policy:
    """Bounds of a cleaning run; a ratio bound below 0 is off."""

    min_score: float = 4.0
    min_chars: int = 200
    max_chars: int = 16_384
    min_cjk_ratio: float = 0.25
    normalize_unicode: bool = False
    dedupe_mode: str = "normalized"
    max_repeated_line_ratio: float = 0.35
    max_url_ratio: float = 0.20
    max_html_ratio: float = 0.10
    max_punctuation_ratio: float = 0.45
    max_digit_ratio: float = 0.35

    def __post_init__(self):
        if self.min_chars < 0 or self.max_chars < max(1, self.min_chars):
            raise ValueError("max_chars must be at least 1 and not below min_chars")
        if self.dedupe_mode not in ("normalized", "exact", "none"):
            raise ValueError("dedupe_mode is normalized, exact or none")

    def columns(self) -> dict[str, Column]:
        return {k: F.lit(v) for k, v in vars(self).items()}


def _over(value: Column, bound: Column) -> Column:
    return (bound >= 0) & (value > bound)


def text_reason(t: Column | str, p: dict[str, Column], visible: Column | None = None) -> Column:
    """The first reason to reject a cleaned text; null for one that is kept. ``visible``: its characters that aren't blank, if a column has them."""
    t = tx.col(t)
    v = tx.visible_chars(t) if visible is None else visible
    return (
        F.when(F.length(t) < p["min_chars"], "too_short")
        .when(F.length(t) > p["max_chars"], "too_long_after_split")
        .when(tx.cjk_ratio(t, v) < p["min_cjk_ratio"], "low_cjk_ratio")
        .when(v == 0, "empty_text_after_clean")
        .when(_over(tx.url_ratio(t), p["max_url_ratio"]), "high_url_ratio")
        .when(_over(tx.html_ratio(t), p["max_html_ratio"]), "high_html_ratio")
        .when(_over(tx.punctuation_ratio(t, v), p["max_punctuation_ratio"]), "high_punctuation_ratio")
        .when(_over(tx.digit_ratio(t, v), p["max_digit_ratio"]), "high_digit_ratio")
        .when(_over(tx.repeated_line_ratio(t), p["max_repeated_line_ratio"]), "high_repeated_line_ratio")
    )


def record_reason(score: Column | str, cleaned: Column | str, p: dict[str, Column]) -> Column:
    """The reasons that come before cutting into chunks: score, emptiness, broken characters.

    A null score counts as minus infinity; NaN isn't below any bound.
    """
    s, t = F.coalesce(tx.col(score).cast("double"), F.lit(float("-inf"))), tx.col(cleaned)
    return (
        F.when((s < p["min_score"]) & ~F.isnan(s), "score_below_minimum")
        .when(F.coalesce(t, F.lit("")) == "", "empty_text_after_clean")
        .when(F.contains(t, F.lit("�")), "replacement_character")
    )


def join_policies(records: DataFrame, policies: DataFrame, source_col: str = "source") -> DataFrame:
    """The records with their source's policy as one struct ``policy``; sources are compared trimmed, in lower case."""
    names = list(Policy.__dataclass_fields__)
    pol = policies.select(F.lower(F.trim("source")).alias("_s"), F.struct(*names).alias("policy")).dropDuplicates(["_s"])
    return records.withColumn("_s", F.lower(F.trim(F.col(source_col)))).join(pol, "_s", "left").drop("_s")


def policy_columns(struct: str = "policy", default: Policy = Policy()) -> dict[str, Column]:
    """Columns of a joined policy, the defaults where a source has none."""
    return {k: F.coalesce(F.col(struct)[k], v) for k, v in default.columns().items()}


def candidate_reasons(source: Column | str, candidate: Column | str, truncated: Column | str, similarity: Column | None = None) -> Column:
    """All reasons against a rewritten text, in a fixed order; an empty array accepts it.

    Both texts are taken as they are (fold compatibility forms before, if wanted). Without ``similarity``
    the surface check is left out.
    """
    s, c = tx.strip(F.coalesce(tx.col(source), F.lit(""))), tx.strip(F.coalesce(tx.col(candidate), F.lit("")))
    ns, nc = F.length(tx.compact(s)), F.length(tx.compact(c))
    share = F.try_divide(nc.cast("double"), ns.cast("double"))
    when = lambda cond, name: F.when(cond, F.lit(name))
    found = [
        when(c == "", "empty_output"),
        when(c == s, "model_kept_identity"),
        when((tx.surface(s) == tx.surface(c)) & (c != s), "punctuation_or_spacing_only"),
        when(nc < 2, "too_short"),
        when(share < 0.35, "over_compressed"),
        when(share > 1.05, "longer_than_allowed"),
        *([when(similarity < 0.4, "low_surface_similarity")] if similarity is not None else []),
        when(~tx.numbers_kept(tx.numbers(s, tx.NUMBER_SPAN), tx.numbers(c, tx.NUMBER_SPAN)), "number_loss"),
        when(F.coalesce(tx.col(truncated), F.lit(False)), "generation_length_limit"),
        when(F.regexp_like(c, F.lit(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")), "control_character"),
        when(tx.unchanged_end(s, c), "incomplete_ending"),
    ]
    return F.array_compact(F.array(*found))
