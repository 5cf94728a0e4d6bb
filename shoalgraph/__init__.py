"""Ecological-graph and training-data analytics written for Spark DataFrames."""
