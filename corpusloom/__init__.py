"""Corpus curation and evaluation on Spark."""
