"""Operators for building training corpora at scale.

Nothing outside this package imports it.  Each operator lives in a module of
its own; ``queries`` holds the thin whole-table queries.
"""
