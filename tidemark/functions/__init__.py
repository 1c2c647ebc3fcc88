"""Market-domain functions."""
