"""Operators for large text corpora: scans, deduplication, classification and tokens.

Nothing else in the library imports this package.
"""
