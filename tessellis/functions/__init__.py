"""Column expressions for text, numbers, periods and units."""
