"""Training-data operators: encoding, near-duplicates, sharding, scoring, filtering and packing."""
