"""Market-bar analytics on Spark: ingest, session labels, roll-ups, candle patterns, reads and streams."""
