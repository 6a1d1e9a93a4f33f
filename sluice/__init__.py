"""Percolation (reverse search) on Spark: filters are registered, rows are tested against them."""
