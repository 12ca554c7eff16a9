"""termweave: term co-occurrence networks and corpus preparation on Spark DataFrames."""
