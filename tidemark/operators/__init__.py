"""Market-domain operators."""
