"""Sensor telemetry analytics on Spark: a log of JSON messages in, result tables and live views out."""
