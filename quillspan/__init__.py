"""Spark jobs that keep and search an index over a large collection of text files."""
