"""Code-intelligence and text analytics on Spark DataFrames."""
