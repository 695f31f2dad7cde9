"""Column expressions and small solvers."""
