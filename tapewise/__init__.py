"""Market-signal analytics on Spark: panel operators keyed by (ticker, date)."""
