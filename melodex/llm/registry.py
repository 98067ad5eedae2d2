"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, embedding_dedup, filter_audit, language_id, line_dedup, lm_score, mixing, simhash, spelling, suffix_dedup, token_counts, url_filter, warc

MODULES = (decontaminate, embedding_dedup, filter_audit, language_id, line_dedup, lm_score, mixing, simhash, spelling, suffix_dedup, token_counts, url_filter, warc)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in MODULES for k, v in m.ORACLE.items()}
