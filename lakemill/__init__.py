"""Analytics and corpus curation on Spark DataFrames."""
