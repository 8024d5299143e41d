"""Column builders (Catalyst expressions only)."""
