"""Operators that prepare training text: dedup, scans, filters, mixing.

Nothing outside this subpackage imports it; ``registry`` lists its queries.
"""
