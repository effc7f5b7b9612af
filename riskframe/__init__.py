"""Security-signal and measurement analytics as Spark DataFrame operators."""
