"""Quernstone: a Spark-native engine for mixed structured and free-text record collections."""
