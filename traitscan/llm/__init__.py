"""Training-data operators: sharding, dedup, tokens, packing, search, filters."""
