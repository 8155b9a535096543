"""Training-data operators: deduplication, search, archives, mixing, language, tokens, shards, secrets.

Nothing outside this subpackage imports it; it can be removed as a whole.
"""
