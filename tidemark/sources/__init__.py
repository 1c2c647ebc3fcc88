"""Market-domain sources."""
