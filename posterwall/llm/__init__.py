"""Training-data operators: quality, deduplication, tokens, archives, models, mixing."""
