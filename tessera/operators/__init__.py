"""General data-processing operators, each a function from DataFrames to DataFrames."""
