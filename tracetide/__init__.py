"""Time-series, state-interval and pair analytics on Spark DataFrames."""
