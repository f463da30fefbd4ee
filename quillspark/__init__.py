"""Spark-native analytics of model-evaluation traces."""
