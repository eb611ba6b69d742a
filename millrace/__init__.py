"""Declarative data pipelines and corpus preparation on Spark."""
