"""Market-domain streaming."""
