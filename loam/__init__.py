"""A Spark-native engine for text retrieval and paired evaluation analytics."""
