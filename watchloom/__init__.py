"""Security-telemetry data work as Spark DataFrame operators."""
