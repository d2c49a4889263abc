"""Candidate matching, ranking and corpus preparation on Spark DataFrames."""
