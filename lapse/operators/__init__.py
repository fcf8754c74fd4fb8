"""DataFrame operators.  Each function: DataFrames in, lazy DataFrame out."""
