"""Table operators: every function takes DataFrames and returns a DataFrame."""
