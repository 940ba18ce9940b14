"""Gaussian models on sparse matrices kept as (row, col, value) tables."""
