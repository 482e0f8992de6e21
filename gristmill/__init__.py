"""gristmill: point-in-time equity analytics on Spark DataFrames."""
