"""Operators for preparing language-model training corpora.

Nothing else in the library imports this subpackage; the queries it offers are
collected in :mod:`corpusgraph.llm.queries`.
"""
