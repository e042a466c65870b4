"""Column expressions. Every function takes columns (or column names) and returns a Column."""
