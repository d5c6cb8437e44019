"""crashlens.functions."""
