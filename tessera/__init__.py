"""Spark-native analytics: column profiling, de-identification, record assembly and validation, and synthetic-data scoring."""
