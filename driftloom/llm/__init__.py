"""Training-data operators: deduplication, extraction, scoring, mixing, tokens, packing."""
