"""Lorekeep: hybrid retrieval and lifecycle analytics over text memories, on Spark."""
