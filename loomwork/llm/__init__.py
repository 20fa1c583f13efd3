"""Training-data operators: near-dedup, archives, quality, mixing, tokens, language, licences, extraction."""
