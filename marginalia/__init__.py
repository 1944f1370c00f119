"""Corpus search and feed ingest as Spark DataFrame operations."""
