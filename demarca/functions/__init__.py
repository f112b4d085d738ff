"""Column expressions: cleaning, keys, measures and geometry."""
