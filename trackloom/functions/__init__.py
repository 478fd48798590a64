"""Column expressions and the few helpers that need Python."""
