"""Column functions: every one is a tree of built-in expressions."""
