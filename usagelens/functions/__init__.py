"""Column helpers and statistics used by the operators."""
