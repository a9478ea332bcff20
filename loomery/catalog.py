"""The core's queries and their SQL."""

from __future__ import annotations

from .plans import cleaning, curation, evaluation, instruct, pairs, tokens

MODULES = (cleaning, curation, pairs, tokens, evaluation, instruct)
#: Sums that SQL gives in a wider type than Spark does.
SUMS = {
    "char_class_profile": "han digits punctuation latin chars bytes", "record_summary": "chars", "pair_statistics": "rows unchanged_pairs target_longer_than_source", "length_relations": "source_chars target_chars",
    "merged_targets": "target_chars", "must_keep_terms": "terms missing", "interval_union_coverage": "covered total", "doc_coverage": "tokens tokens_256 tokens_512 tokens_1024", "unigram_entropy": "tokens", "token_starts": "start",
    "text_metrics_bits": "chars", "language_model_report": "tokens", "template_masks": "chars labelled",
}


def queries():
    return {f.__name__: f for m in MODULES for f in m.QUERIES}


def _typed(name: str, sql: str) -> str:
    casts = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in SUMS.get(name, "").split())
    return f"SELECT * REPLACE ({casts}) FROM ({sql}) AS q" if casts else sql


def oracle_sql():
    return {k: _typed(k, v) for m in MODULES for k, v in m.SQL.items()}
