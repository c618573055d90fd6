"""Training-data operators: deduplication, filtering, mixing, sharding and search."""
