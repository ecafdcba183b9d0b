"""A Spark-native analytics engine for engineering knowledge."""
