"""Matrices, grids, point sets and block data as DataFrames."""
