"""Training-data operators: deduplication, scans, counting, mixing, filtering and sharding of documents."""
