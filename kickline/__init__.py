"""Point-in-time match analytics on Spark DataFrames."""
