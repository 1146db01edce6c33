"""pubspark: a Spark-native engine for scholarly-publication metadata."""
