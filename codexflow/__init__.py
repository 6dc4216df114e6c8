"""codexflow: Spark-native analytics over annotated text collections."""
