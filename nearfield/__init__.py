"""Nearfield: nearest-neighbour search and vector data processing on Spark DataFrames."""
