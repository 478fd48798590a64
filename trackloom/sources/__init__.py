"""Corpus readers, table readers and writers."""
