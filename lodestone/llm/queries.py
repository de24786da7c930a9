"""The operators as registered queries, with SQL where it can express them."""

from __future__ import annotations

from lodestone.llm import chat_format, conversation_trie, decontaminate, html_extract, ngram_join, packing, quality_rules, sharding, suffix_dedup, token_counts, topk_search, toxicity, vector_codes

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.query,
    "op2_quality_rules": quality_rules.query,
    "op3_decontaminate": decontaminate.query,
    "op4_chat_format": chat_format.query,
    "op5_sharding": sharding.query,
    "op6_html_extract": html_extract.query,
    "op7_ngram_join": ngram_join.query,
    "op8_packing": packing.query,
    "op9_token_counts": token_counts.query,
    "op10_toxicity": toxicity.query,
    "op11_vector_codes": vector_codes.query,
    "op12_conversation_trie": conversation_trie.query,
    "op13_topk_search": topk_search.query,
}
SQL = {"op2_quality_rules": quality_rules.SQL, "op3_decontaminate": decontaminate.SQL, "op4_chat_format": chat_format.SQL, "op5_sharding": sharding.SQL, "op11_vector_codes": vector_codes.SQL, "op12_conversation_trie": conversation_trie.SQL, "op13_topk_search": topk_search.SQL}
