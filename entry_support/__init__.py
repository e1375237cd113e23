"""Queries over the driver's tables: mapping, registered queries, and their SQL."""
