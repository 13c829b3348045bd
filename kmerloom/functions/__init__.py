"""Scalar functions over sequences, as Columns and as plain kernels."""
