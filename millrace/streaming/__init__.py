"""Pipelines over arriving files."""
