"""Change-set and text review analytics on Spark DataFrames."""
