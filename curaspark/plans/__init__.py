"""Composed plans: runs, publication, fixture tables, queries and their SQL."""
