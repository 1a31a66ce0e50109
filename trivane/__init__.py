"""Ternary dataflow analytics on Spark."""
