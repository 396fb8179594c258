"""Queries of this subpackage and their DuckDB statements, by name."""

from __future__ import annotations

import corpus_pipeline
from mailrank.llm import byte_bpe, chat, collocations, mixing, prefix_trie, quality, repeats, sharding, simhash, token_files, toxicity, vector_search, warc

QUERIES = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_token_files": token_files.op3_token_files,
    "op4_simhash_components": simhash.op4_simhash_components,
    "op5_suffix_repeats": repeats.op5_suffix_repeats,
    "op6_source_mixing": mixing.op6_source_mixing,
    "op7_exact_topk": vector_search.op7_exact_topk,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_warc_index": warc.op9_warc_index,
    "op10_byte_bpe": byte_bpe.op10_byte_bpe,
    "op11_conversation_trie": prefix_trie.op11_conversation_trie,
    "op12_collocations": collocations.op12_collocations,
    "op13_sharding": sharding.op13_sharding,
    "pipeline": corpus_pipeline.run,
}

ORACLE: dict[str, str] = {
    "op1_chat_format": chat.SQL,
    "op6_source_mixing": mixing.SQL,
    "op7_exact_topk": vector_search.SQL,
    "op8_quality_rules": quality.SQL,
    "op9_warc_index": warc.SQL,
    "op11_conversation_trie": prefix_trie.SQL,
    "op12_collocations": collocations.SQL,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
