"""Queries over the projected graph, each with the SQL that gives the same rows."""
