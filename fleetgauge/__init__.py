"""Fleet database-telemetry analytics on Spark."""
