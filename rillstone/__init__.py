"""Batch commit log and corpus operators on PySpark."""
