"""Tidemark: point-in-time market analytics as DataFrame-to-DataFrame functions on Spark."""
