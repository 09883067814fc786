"""Spark-native multilingual text-toxicity analytics."""
