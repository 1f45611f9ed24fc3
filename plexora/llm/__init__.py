"""Training-data operators: toxicity, quality, joins, decontamination, packing and more.

Nothing outside this subpackage imports it; the queries over the corpus tables
are in :mod:`plexora.llm.queries`.
"""
