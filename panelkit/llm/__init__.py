"""Training-data operators: tokens, privacy, secrets, search, mixing, quality, toxicity, near-duplicates, archives."""
