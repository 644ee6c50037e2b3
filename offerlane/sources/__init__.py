"""Readers and parsers that turn tables, pages and JSON into offer rows."""
