"""runweave: event-log analytics on Spark DataFrames."""
