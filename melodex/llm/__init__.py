"""Training-data operators: scoring, deduplication, filtering, counting, mixing and archive checks on Spark."""
