"""Queries of the operators in this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import (
    decontaminate, line_dedup, minhash, pieces, prefix_trie, quality, sharding, simhash, substring, token_counts, toxicity,
    turn_repair, warc,
)

QUERIES = {f.__name__: f for f in (
    sharding.op1_sharding, warc.op2_warc, pieces.op3_sentencepiece, quality.op4_quality_rules,
    line_dedup.op5_line_dedup, simhash.op6_simhash, substring.op7_substring_dedup, toxicity.op8_toxicity,
    token_counts.op9_token_counts, decontaminate.op10_decontamination,
    prefix_trie.op11_prefix_trie, turn_repair.op12_turn_repair, minhash.op13_minhash,
)}
SQL = {"op1_sharding": sharding.SQL, "op2_warc": warc.SQL, "op10_decontamination": decontaminate.SQL,
       "op11_prefix_trie": prefix_trie.SQL, "op12_turn_repair": turn_repair.SQL, "op13_minhash": minhash.SQL}
