"""Code-knowledge-base analytics on Spark DataFrames."""
