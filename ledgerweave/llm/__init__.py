"""Training-data operators: chat rendering, token shards, mixing, near-duplicates, filters, fingerprints."""
