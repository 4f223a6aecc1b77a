"""Structured Streaming counterparts of the bar sources."""
