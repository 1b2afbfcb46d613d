"""Batch and streaming estimation analytics on Spark, for many projects at once."""
