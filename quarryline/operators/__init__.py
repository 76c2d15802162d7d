"""Set-oriented operators: DataFrames in, a DataFrame out."""
