"""Operators of a training-data pipeline: dedup, filters, tokens, packing.

Nothing else in :mod:`weftspark` imports this subpackage.
"""
