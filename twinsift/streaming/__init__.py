"""Increments and Structured Streaming."""
