"""Code-security analytics on Spark DataFrames."""
