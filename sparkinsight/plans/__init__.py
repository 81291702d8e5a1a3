"""Fixtures, pipelines, reports and the query registry."""
