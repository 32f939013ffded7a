"""Column expressions for semantic types."""
