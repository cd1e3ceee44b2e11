"""Training-data operators: filtering, deduplication, sharding, formatting and tokenising of text tables."""
