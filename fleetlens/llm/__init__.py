"""Training-data operators on Spark: language, extraction, similarity, archives, tokens, leaks, quality, shards, search."""
