"""Training-data operators: language, quality, privacy, dedup, mixing, tokens, chat and media."""
