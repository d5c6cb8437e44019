"""crashlens.sources."""
