"""Registered queries: operator compositions over the given tables."""
