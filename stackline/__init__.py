"""Spark jobs for library holdings and training data."""
