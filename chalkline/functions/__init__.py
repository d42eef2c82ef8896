"""Column expressions: predicates, scores and scalar functions."""
