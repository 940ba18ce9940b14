"""Gridded-observation analytics on Spark."""
