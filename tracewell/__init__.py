"""Provenance analytics on Spark DataFrames."""
