"""Risk-controlled sampling analytics on Spark DataFrames."""
