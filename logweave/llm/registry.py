"""Queries of this package and their DuckDB SQL."""

from __future__ import annotations

from . import bm25_search, collocations, graph_search, language_id, mixing, ngram_jaccard, periodic_runs, quality_rules, sentence_pieces, sharding, token_counts, toxicity, url_filter

QUERIES = {
    "op1_ngram_jaccard": ngram_jaccard.query,
    "op2_token_counts": token_counts.query,
    "op3_sentence_pieces": sentence_pieces.query,
    "op4_mixing": mixing.query,
    "op5_toxicity": toxicity.query,
    "op6_graph_search": graph_search.query,
    "op7_url_filter": url_filter.query,
    "op8_bm25_search": bm25_search.query,
    "op9_language_id": language_id.query,
    "op10_sharding": sharding.query,
    "op11_quality_rules": quality_rules.query,
    "op12_collocations": collocations.query,
    "op13_periodic_runs": periodic_runs.query,
}
ORACLES: dict[str, str] = {"op8_bm25_search": bm25_search.ORACLE, "op12_collocations": collocations.ORACLE}
