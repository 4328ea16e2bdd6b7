"""Spark-native analytics for keyed, event-time, multi-stream sensor telemetry."""

__version__ = "0.1.0"
