"""Trade-network analytics on Spark DataFrames."""
