"""Distributed operators: k-mer counts, the index views, and correction."""
