"""Functions of the semantic engine."""
