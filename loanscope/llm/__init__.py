"""Training-data operators: sharding, tokens, packing, search, dedup, language, privacy, quality."""
