"""Operators of a training-data pipeline: tokenising, packing, filtering, de-duplicating and scoring documents.

Nothing outside this subpackage imports it.
"""
