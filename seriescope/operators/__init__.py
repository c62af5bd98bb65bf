"""Operators on series: identity, counts, windows, group limits, sketches, and what is asked of estimates."""
