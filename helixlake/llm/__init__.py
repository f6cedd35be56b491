"""Operators for preparing language-model training data on Spark.

Each module holds one operator with a general interface and, at its end, the
thin query that is registered for it.  Nothing outside this subpackage imports it.
"""
