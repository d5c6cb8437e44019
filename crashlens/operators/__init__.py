"""crashlens.operators."""
