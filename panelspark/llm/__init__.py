"""Training-data operators: deduplication, packing, scans, tokenization, language identification and scoring.

Nothing outside this folder imports it. ``panelspark.llm.registry`` pairs each operator with its registered query.
"""
