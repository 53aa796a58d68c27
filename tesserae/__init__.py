"""Multi-vector retrieval on Spark DataFrames."""
