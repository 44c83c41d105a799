"""Column expressions: strict parameter equality, declaration order, constraints, row comparison."""
