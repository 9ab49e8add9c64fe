"""Candidate-list ranking evaluation on PySpark DataFrames."""

__version__ = "0.1.0"
