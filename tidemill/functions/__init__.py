"""Column functions: text, parsing, identity."""
