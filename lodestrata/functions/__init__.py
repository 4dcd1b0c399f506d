"""Column expressions and functions to register."""
