"""Corvane: building and judging code-retrieval datasets on Spark."""

__version__ = "0.1.0"
