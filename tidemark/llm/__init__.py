"""Operators for preparing training corpora, and the queries that apply them.

Nothing outside this subpackage imports it.  ``queries`` and ``oracle_sql`` in
``tidemark.llm.catalog`` list the registered queries.
"""
