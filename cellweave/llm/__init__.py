"""Operators for preparing language-model training corpora at scale.

Each module holds one operator with a general interface, and the thin registered
query that applies it to the project's standard tables.  ``registry`` collects
the queries and their SQL oracles.
"""
