"""Operators for training-data pipelines.

Nothing else in the library imports this subpackage; it can be removed with
its tests without touching the rest.
"""
