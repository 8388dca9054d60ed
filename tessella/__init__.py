"""tessella: a Spark-native graph retrieval and text processing engine."""
