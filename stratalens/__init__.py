"""Stratalens: a Spark-first engine for searchable, citable document collections."""
