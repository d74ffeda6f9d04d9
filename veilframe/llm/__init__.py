"""Operators for preparing training data from large text collections.

Nothing else in the library imports this subpackage.
"""
