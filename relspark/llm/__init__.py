"""Operators for preparing training data: mixing, counting, scoring, joining, encoding, sharding.

Nothing outside this subpackage imports it.
"""
