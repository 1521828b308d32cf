"""The queries of this subpackage and the SQL that each must agree with."""

from __future__ import annotations

from furrow.llm import (
    chat_format, decontamination, html_text, language_id, lm_scoring, personal_data, prefix_trie, quality_rules, simhash_dedup, source_mix, substring_dedup, toxicity, vector_codes,
)

MODULES = [substring_dedup, simhash_dedup, quality_rules, decontamination, html_text, source_mix, lm_scoring, language_id, toxicity, chat_format, personal_data, prefix_trie, vector_codes]

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
