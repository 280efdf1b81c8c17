"""A governed semantic layer and verification engine on Spark DataFrames."""
