"""Credit-risk feature, scoring and monitoring jobs on Spark DataFrames."""
