"""Seasonal panel analytics on PySpark: every operator is DataFrame in, DataFrame out."""
