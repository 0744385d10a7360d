"""Residue-embedding search and large-scale table maintenance on Spark DataFrames."""
