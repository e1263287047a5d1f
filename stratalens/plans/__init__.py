"""Composed pipelines and their command lines."""
