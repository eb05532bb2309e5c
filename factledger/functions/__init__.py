"""Column functions: text and numbers."""
