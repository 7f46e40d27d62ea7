"""Interferometric imaging and table analytics on Spark."""
