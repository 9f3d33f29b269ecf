"""Column expressions: cleaning, derived values, text rules."""
