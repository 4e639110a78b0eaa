"""Behavioural-sensing analytics on Spark DataFrames."""
