"""A versioned-table engine on Spark DataFrames."""
