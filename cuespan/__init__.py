"""Timeline, interval and sampled-signal analytics on Spark DataFrames."""
