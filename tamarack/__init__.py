"""Spark jobs for preparing, checking and evaluating training text."""

__version__ = "0.1.0"
