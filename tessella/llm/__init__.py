"""Training-data operators: language ID, mixing, licence scans, vector search, packing,
near-duplicate detection, token output, toxicity, fingerprints and line dedup."""
