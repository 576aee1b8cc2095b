"""sedge: environmental and event time series on Spark DataFrames."""
