"""Scalar and table functions on text and vectors."""
