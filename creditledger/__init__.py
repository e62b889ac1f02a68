"""Contribution accounting over versioned and event-like tables, as Spark DataFrame operators."""
