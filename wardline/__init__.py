"""Wardline: policy analytics over AI-agent tool traffic, on Spark DataFrames."""
