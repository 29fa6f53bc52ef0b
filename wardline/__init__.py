"""Text-threat and call-sequence analytics on Spark DataFrames."""
