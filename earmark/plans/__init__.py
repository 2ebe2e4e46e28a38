"""Queries over the driver tables, with their reference SQL."""
