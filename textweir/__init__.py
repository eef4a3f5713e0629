"""Continuous fuzzy keyword matching, batch and streaming, as Spark jobs."""
