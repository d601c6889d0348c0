"""Operators for large training corpora: filtering, matching, search, extraction, mixing and packing.

Nothing else in the library imports this subpackage. Its registered queries are
in ``queries`` and their SQL in ``oracles``.
"""
