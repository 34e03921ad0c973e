"""Versioned property-graph analytics over relational data, on Spark DataFrames."""
