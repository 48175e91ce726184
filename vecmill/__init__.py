"""Vector analytics over Spark DataFrames."""
