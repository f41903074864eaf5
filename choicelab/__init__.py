"""Choice-experiment and evoked-signal analytics on Spark DataFrames."""
