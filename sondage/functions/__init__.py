"""Column expressions: labels, intervals, text, random numbers."""
