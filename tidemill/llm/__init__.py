"""Training-data operators: packing, toxicity, deduplication, sharding, quality, language, mixing and URL rules.

Nothing outside this subpackage imports it; the queries are in :mod:`tidemill.llm.queries`.
"""
