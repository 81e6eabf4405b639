"""Column functions made of built-in expressions."""
