"""Operators for large text corpora and training data.

The rest of the library imports nothing from here; the subpackage can be
removed as a whole.
"""
