"""Column-level helpers; every one returns a Catalyst expression."""
