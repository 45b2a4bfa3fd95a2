"""Vector analytics and clustering on Spark DataFrames."""
