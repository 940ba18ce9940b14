"""Operators that prepare text corpora for model training.

Nothing outside this subpackage imports it; ``registry`` lists its queries for
the driver entry module.
"""
