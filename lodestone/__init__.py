"""Analytics of typed code graphs, their history and their texts, as functions from DataFrames to DataFrames."""
