"""Column expressions. Nothing in this folder starts a Python worker."""
