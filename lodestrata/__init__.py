"""A Spark-native engine for document and code intelligence and for training-data preparation."""
