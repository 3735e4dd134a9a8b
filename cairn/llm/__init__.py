"""Training-data operators: quality, near and exact duplicates, language, PII, mixing, tokens."""
