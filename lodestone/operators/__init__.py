"""Operators: functions from the tables of a graph to a table."""
