"""plumbline: comparative valuation and corpus preparation on Spark DataFrames."""
