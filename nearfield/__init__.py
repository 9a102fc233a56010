"""Nearest-neighbour search over vector columns of Spark DataFrames."""
