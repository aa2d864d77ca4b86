"""Operators that prepare large text corpora for model training. Nothing else in the library imports this package."""
