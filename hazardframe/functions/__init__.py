"""Column expressions: text, taxonomy, vectors, maths."""
