"""Time-series and panel analytics on bar tables, as Spark DataFrame operations."""
