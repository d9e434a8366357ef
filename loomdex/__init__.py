"""Spark-native hybrid retrieval, segmentation and code-graph analytics."""
