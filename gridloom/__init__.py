"""Map partition analytics on Spark DataFrames."""
