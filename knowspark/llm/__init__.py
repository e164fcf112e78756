"""Training-data operators: deduplication, filtering, tokenising, packing, extraction and scoring.

Nothing outside this subpackage imports it; the queries live in :mod:`knowspark.llm.queries`.
"""
