"""Wildfire-spread analytics on Spark."""
