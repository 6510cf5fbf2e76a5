"""Spark-native analytics over code graphs, verifier logs and classification rules."""
