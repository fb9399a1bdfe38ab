"""Training-data operators: deduplication, scoring, search, tokens, packing. Nothing else in lapwing imports this package."""
