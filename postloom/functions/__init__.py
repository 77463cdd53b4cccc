"""Column expressions: text rules, vectors, event time and hashing."""
