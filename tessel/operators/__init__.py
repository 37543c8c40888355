"""Operators over DataFrames of items, vectors, groups, clusters and folders."""
