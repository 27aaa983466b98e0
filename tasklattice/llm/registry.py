"""Driver-facing queries of this subpackage and their SQL."""

from __future__ import annotations

from tasklattice.llm import language_id, mjpeg_avi, near_dedup, oracles, packing, pieces, pii, quality_rules, sharding, url_filters, warc

QUERIES = {
    "op1_quality_rules": quality_rules.query,
    "op2_best_fit_packing": packing.query,
    "op3_bootstrap_pii": pii.query,
    "op4_histogram_sort": sharding.query,
    "op5_minhash_dedup": near_dedup.query,
    "op6_mjpeg_avi": mjpeg_avi.query,
    "op7_viterbi_pieces": pieces.query,
    "op8_warc_transactions": warc.query,
    "op9_language_id": language_id.query,
    "op9_language_id_pages": language_id.page_query,
    "op10_url_filters": url_filters.query,
}

ORACLE_SQL: dict[str, str] = oracles.SQL
