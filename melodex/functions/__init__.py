"""Column expressions and array kernels."""
