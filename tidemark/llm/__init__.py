"""Operators for preparing training text: ten independent components.

Nothing outside this subpackage imports it; the queries over it live in
:mod:`tidemark.llm.queries`.
"""
