"""Time-windowed event analytics on Spark."""
