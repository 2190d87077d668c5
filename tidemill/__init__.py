"""A declarative data-processing engine whose steps are lazy Spark DataFrame operations."""
