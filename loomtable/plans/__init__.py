"""Plans of schema changes: pure functions, without Spark."""
