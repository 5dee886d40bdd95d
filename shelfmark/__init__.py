"""Stored web pages in, a clean product catalogue out, on Spark DataFrames."""
