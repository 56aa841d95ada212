"""Column functions: all built on Spark's own expressions."""
