"""Readers of corpora and tables."""
