"""Operators on logs of graph operations."""
