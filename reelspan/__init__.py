"""Spoken-moment analytics on Spark DataFrames."""
