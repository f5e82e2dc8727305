"""Operators of a training-data pipeline: tokenising, filtering, deduplication, packing, search and formatting.

Nothing else in the library imports this subpackage; ``queries.py`` registers its queries.
"""
