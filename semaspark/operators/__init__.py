"""Operators of the semantic engine."""
