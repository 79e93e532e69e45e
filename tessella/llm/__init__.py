"""Operators for building training data: de-duplication, scoring, formatting, counting and packing.

Nothing else in the library imports this subpackage.
"""
