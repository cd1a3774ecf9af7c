"""Training-data operators: scoring, deduplication, formatting, filtering and packing.

Nothing else in the package imports this subpackage.
"""
