"""Operators of a training-data pipeline: deduplication, filtering, privacy and tokens.

Nothing outside this subpackage imports it.
"""
