"""Near-duplicate analytics over media and document fingerprints, as Spark DataFrame operations."""
