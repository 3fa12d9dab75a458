"""Scalar functions and kernels: Column in, Column out."""
