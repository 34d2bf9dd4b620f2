"""Batch jobs for governed document corpora on PySpark."""
