"""Object queries over Spark DataFrames."""
