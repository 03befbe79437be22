"""Spark-native engine for economic observations: text to facts, facts to analytics."""
