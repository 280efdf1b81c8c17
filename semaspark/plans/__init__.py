"""Plans of the semantic engine."""
