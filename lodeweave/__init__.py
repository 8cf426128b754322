"""Spark-native retrieval, graph and evaluation engine, with training-data operators beside it."""
