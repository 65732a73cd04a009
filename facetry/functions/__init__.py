"""Column builders: every one returns a native Catalyst expression."""
