"""Spatial cell-embedding analytics expressed with the Spark DataFrame API."""
