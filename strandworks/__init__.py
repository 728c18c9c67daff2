"""Spark-first engine for building, cleaning, expanding and evaluating knowledge graphs."""

__version__ = "0.1.0"
