"""Column-level functions (built-in Spark expressions only)."""
