"""Table operators. Each takes DataFrames and column names and returns a DataFrame."""
