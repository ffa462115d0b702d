"""Corpus ingestion jobs and report writers."""
