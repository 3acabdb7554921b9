"""Column functions: built-in Spark expressions only."""
