"""Attestra: does the documentation still agree with the code?  A PySpark engine."""
