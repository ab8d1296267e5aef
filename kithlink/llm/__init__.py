"""Training-data operators: cleaning, deduplication, tokens, packing. Nothing else in the package imports this."""
