"""Operators for preparing language-model training data, as Spark jobs.

Nothing outside this subpackage imports it.  ``queries`` registers the operators
over the synthetic tables.
"""
