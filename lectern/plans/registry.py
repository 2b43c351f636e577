"""Named queries over the tables of a data folder, and DuckDB SQL for the same rows."""

from __future__ import annotations

from . import forms, passages, preparation, retrieval, similarity, summaries

_MODULES = (retrieval, similarity, passages, summaries, preparation, forms)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
