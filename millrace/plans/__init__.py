"""Declarative configurations turned into Spark plans."""
