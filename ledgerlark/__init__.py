"""ledgerlark: record analytics on Spark DataFrames."""
