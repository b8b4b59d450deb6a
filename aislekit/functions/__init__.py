"""Column expressions: draws, text shaping, constraint tests, routing and scoring."""
