"""Column functions: payload parsing, retry decisions, identifiers."""
