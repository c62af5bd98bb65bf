"""Continuous estimates with Structured Streaming."""
