"""Property-graph, text and event analytics on Spark DataFrames."""
