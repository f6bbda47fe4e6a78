"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from latticeq.llm import decontaminate, exact_dedup, hmm, jaccard_join, language, line_dedup, mixing, pii, secrets, url_filter

QUERIES = {
    "op1_dedup_lines": line_dedup.op1_dedup_lines,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_language_id": language.op4_language_id,
    "op5_find_personal_data": pii.op5_find_personal_data,
    "op6_find_secrets": secrets.op6_find_secrets,
    "op7_hmm_score": hmm.op7_hmm_score,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_filter_urls": url_filter.op9_filter_urls,
    "op10_mix_sources": mixing.op10_mix_sources,
}
SQL = {
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op8_jaccard_join": jaccard_join.OP8_SQL,
}
