"""Property-graph analytics on Spark: graphs as DataFrames, a MATCH language, and graph algorithms."""
