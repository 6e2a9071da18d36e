"""Privacy and action-safety analytics on Spark DataFrames and streams."""
