"""Column expressions and small reusable Spark patterns."""
