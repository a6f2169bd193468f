"""Column expressions: scalar functions and predicates."""
