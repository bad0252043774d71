"""Spark-native engine for building, auditing, scoring and evaluating email threat corpora."""
