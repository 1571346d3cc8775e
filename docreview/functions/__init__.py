"""Column expressions and scan helpers shared by the operators."""
