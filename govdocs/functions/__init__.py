"""Column expressions and vectorized helpers."""
