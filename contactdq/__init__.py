"""Contact-data and identity-data quality on Spark DataFrames."""
