"""Analytics of daily market prices as Spark DataFrame operations."""
