"""Streaming of the semantic engine."""
