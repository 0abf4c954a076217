"""Operators of a training-data pipeline.

Nothing outside this subpackage imports it.  ``queries.py`` holds the thin
``opN_<name>`` queries, the other modules the operators themselves.
"""
