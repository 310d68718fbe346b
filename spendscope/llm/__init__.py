"""Operators for preparing training data: tokenizing, archives, fingerprints, packing, deduplication, filters, search.

Nothing else in the library imports this subpackage.
"""
