"""Quarry: a Spark-native engine for code search, code graphs and text analytics."""
