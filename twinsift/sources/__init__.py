"""Readers and the shapes of what they read."""
