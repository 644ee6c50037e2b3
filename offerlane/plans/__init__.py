"""Composed pipelines and the registered queries."""
