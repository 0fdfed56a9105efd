"""Gondola: a Spark-native engine for retail panel analytics."""
