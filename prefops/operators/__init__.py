"""DataFrame operators: take DataFrames, return DataFrames."""
