"""Tidemark: a PySpark-native engine for event-driven signal analytics."""
