"""Structured Streaming jobs that keep a graph in sync."""
