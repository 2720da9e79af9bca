"""Column expressions: normal tail, safe arithmetic, column names, verdict blocks."""
