"""Column functions: text, numbers, vectors."""
