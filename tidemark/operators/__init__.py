"""DataFrame operators. Each takes and returns lazy DataFrames and works on all users at once."""
