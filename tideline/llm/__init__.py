"""Training-data operators: deduplication, formatting, token accounting, packing, redaction, sharding, scoring."""
