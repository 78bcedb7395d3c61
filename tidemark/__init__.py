"""Time-series and market-microstructure analytics on Spark."""
