"""Column expressions and rules that pick columns by name."""
