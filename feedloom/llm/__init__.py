"""Operators for large training corpora: deduplication, search, packing, scoring, filtering, mixing.

Nothing else in the library imports this subpackage; each module holds one operator and ``queries``
holds the registered queries with their SQL.
"""
