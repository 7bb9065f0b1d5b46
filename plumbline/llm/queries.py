"""The queries opN_ of the llm subpackage, with SQL where SQL can say it."""

from __future__ import annotations

from plumbline.llm import query_chat, query_infill, query_language, query_media, query_mixing, query_sentencepiece, query_simhash, query_substrings, query_tokens, query_topk, query_toxicity, query_variants, query_warc

MODULES = (query_simhash, query_toxicity, query_topk, query_warc, query_sentencepiece, query_chat, query_mixing, query_substrings, query_media, query_tokens, query_infill, query_language, query_variants)

QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
