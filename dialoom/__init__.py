"""Spark-first engine for curating, scoring and reporting on dialogue data."""
