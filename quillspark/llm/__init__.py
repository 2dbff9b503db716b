"""Operators of a training-data pipeline: packing, filtering, mixing, deduplication, output.

Nothing outside this subpackage imports it.  ``registry`` holds the queries
``op1_`` ... ``op10_`` and ``pipeline`` together with their SQL.
"""
