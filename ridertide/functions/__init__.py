"""Column expressions and small closed-form solvers."""
