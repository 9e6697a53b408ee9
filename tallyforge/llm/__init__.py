"""Operators for large text corpora, each with one registered query."""
