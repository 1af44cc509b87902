"""Operators for preparing training data: packing, filtering, scoring, tokenising, search, extraction, redaction and near-duplicates.

Nothing outside this subpackage imports it. Each operator takes DataFrames and the names
of the columns it reads, and ignores every other column; the thin queries over the
test tables are in :mod:`passagekit.llm.queries`.
"""
