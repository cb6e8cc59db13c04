"""Spark-native analytics over conversational memory, machine traces and documents."""
