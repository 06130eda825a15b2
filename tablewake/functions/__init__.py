"""Column expressions: text cleaning, names, table references."""
