"""Offer matching, comparison and search as Spark DataFrame operators."""
