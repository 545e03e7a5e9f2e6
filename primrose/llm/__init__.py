"""Operators of a training-data pipeline. Nothing else in the library imports
this package; `queries.py` registers one query for each operator."""
