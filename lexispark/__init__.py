"""Domain-concept indexing and retrieval on Spark DataFrames."""
