"""Spark-native code-graph and evidence-retrieval engine."""
