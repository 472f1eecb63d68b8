"""Operators for preparing language-model training data.

Nothing outside this folder imports it; the queries of its operators are in
``cuelens.llm.queries``.
"""
