"""A Spark-native engine for layered spatial data."""
