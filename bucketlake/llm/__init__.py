"""Training-data operators: quality, tokenising, extraction, deduplication,
chat parsing, mixing, nearest neighbours, toxicity and archives.

Nothing outside this subpackage imports it, apart from a guarded import in
``__spark_entry__``.
"""
