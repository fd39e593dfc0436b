"""A Spark-native telemetry analytics library."""
