"""Sources of the semantic engine."""
