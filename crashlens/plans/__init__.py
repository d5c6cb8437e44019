"""crashlens.plans."""
