"""Batch operators over streams of appended files."""
