"""Projections of given tables, registered queries and their SQL."""
