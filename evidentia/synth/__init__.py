"""Synthetic cases with known truth, as DataFrame plans."""
