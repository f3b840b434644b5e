"""Kairoframe: temporal text analytics on Spark DataFrames."""
