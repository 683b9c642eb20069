"""Fleet database-telemetry analytics as Spark DataFrame operators."""
