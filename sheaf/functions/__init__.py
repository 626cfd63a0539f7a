"""Column functions: text, vectors, JSON."""
