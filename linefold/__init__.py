"""linefold: line-, token- and region-level analytics on Spark DataFrames."""
