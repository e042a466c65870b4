"""DataFrame operators: every function takes DataFrames and column names and returns a DataFrame."""
