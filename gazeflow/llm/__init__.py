"""Training-data operators: deduplication, archives, packing, classification, mixing, scoring and search."""
