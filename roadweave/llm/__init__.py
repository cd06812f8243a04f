"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage.  ``queries`` registers one
query per operator; each operator lives in a module of its own.
"""
