"""Registered queries of this subpackage and the SQL that states their results where SQL can."""

from __future__ import annotations

from gridloom.llm import (
    chat,
    exact_dedup,
    html_text,
    jaccard_join,
    mixing,
    packing,
    pii,
    prefix_trie,
    suffix_dedup,
    token_records,
    toxicity,
    weighted_sampling,
    whitening,
)

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_pii": pii.op2_pii,
    "op3_token_records": token_records.op3_token_records,
    "op4_mixing": mixing.op4_mixing,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_fingerprints": weighted_sampling.op6_fingerprints,
    "op7_html_text": html_text.op7_html_text,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_packing": packing.op9_packing,
    "op10_chat": chat.op10_chat,
    "op11_suffix_dedup": suffix_dedup.op11_suffix_dedup,
    "op12_whitening": whitening.op12_whitening,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}
EXPECTED = {
    "op1_exact_dedup": exact_dedup.EXPECTED_SQL,
    "op4_mixing": mixing.expected_sql(),
    "op10_chat": chat.EXPECTED_SQL,
    "op13_prefix_trie": prefix_trie.EXPECTED_SQL,
}
