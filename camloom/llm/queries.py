"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from camloom.llm import bytebpe, chat, html, media, mixing, packing, quality, runs, search, sharding, simhash, suffixes, tokens

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_media_columns": media.op2_media_columns,
    "op3_suffix_dedup": suffixes.op3_suffix_dedup,
    "op4_html_extraction": html.op4_html_extraction,
    "op5_packing": packing.op5_packing,
    "op6_token_counts": tokens.op6_token_counts,
    "op7_simhash": simhash.op7_simhash,
    "op8_sharding": sharding.op8_sharding,
    "op9_chat_formatting": chat.op9_chat_formatting,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_periodic_runs": runs.op11_periodic_runs,
    "op12_ranked_search": search.op12_ranked_search,
    "op13_byte_bpe": bytebpe.op13_byte_bpe,
}
ORACLES = {
    "op1_mixing": mixing.oracle_sql(),
    "op8_sharding": sharding.oracle_sql(),
    "op10_quality_rules": quality.oracle_sql(),
    "op12_ranked_search": search.oracle_sql(),
}
