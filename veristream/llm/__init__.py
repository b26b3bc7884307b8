"""Training-data operators: text quality, deduplication, mixing, scoring and tokenization.

Nothing outside this subpackage imports it.  Queries are listed in :mod:`veristream.llm.registry`.
"""
