"""Queries by area; each module has QUERIES and SQL by name."""
