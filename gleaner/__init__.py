"""Web-lead analytics and corpus preparation on Spark DataFrames."""
