"""Operators for preparing training data at scale.

Nothing outside this subpackage imports it.  Every operator takes and returns DataFrames; the thin
queries that the registry exposes are in :mod:`quillon.llm.queries`.
"""
