"""Signalling-trace analytics on Spark DataFrames."""
