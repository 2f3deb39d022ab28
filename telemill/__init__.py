"""Telemetry normalisation and analytics on PySpark."""
