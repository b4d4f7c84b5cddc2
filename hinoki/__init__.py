"""Spark-native engine for honorific-usage checking and corpus processing."""
