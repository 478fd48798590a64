"""Composite pipelines, the views over the driver tables and the query registry."""
