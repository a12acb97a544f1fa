"""pitspark: point-in-time event studies on Spark DataFrames."""
