"""Composite queries (CQ-1 .. CQ-25).

Each takes ``t``, a mapping of clinic table names to DataFrames, and answers for
all keys at once.
"""
